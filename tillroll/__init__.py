"""tillroll — retail point-of-sale analytics on Spark DataFrames.

Subpackages
-----------
sources    model schema, test-table mapping, loaders and sinks
functions  column-expression helpers (money, date ranges, loyalty, presentation)
operators  reports, listings, ledger arithmetic, integrity checks, carts
plans      reusable plan shapes: size-checked broadcast, OR-key lookup, paging, top-k
streaming  Structured Streaming twins of the live figures and order intake
"""

from tillroll.session import get_session, checkpoint_dir  # noqa: F401
from tillroll.sources.catalog import Retail  # noqa: F401
