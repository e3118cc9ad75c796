"""Corpus-wide line dedup (DataFrame functions only).

Lines of every document are normalised, hashed and exploded; a line key found
in at least ``min_docs`` documents is frequent, and all its lines are dropped;
the other lines are put together again in order.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased;
two 64-bit hashes stand for it.  A document counts a key once (its own hashes
are made distinct before the explode), so counting is one aggregate that
combines before its shuffle: a line in a third of all documents costs one row
per task.  Only (document, position) pairs of frequent lines travel back to
their documents; a frequent key's lines are spread by the join's skew split.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; each row is a document (a repeated
row is one more document, and gets the same result); a null ``doc_id`` is kept
and matched as a value; columns besides ``doc_id`` and ``text`` pass through
``dedup`` untouched.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
MIN_DOCS = 10


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_BLANK))
    # lower() is the fast way where every character is ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _with_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t (hash of the text, to tell rows of one id apart), hs: per line its key's hash, or null for a short key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(F.split(text, "\n"), line_key)
    return docs.select("doc_id", _hash(text).alias("t"), F.transform(
        keys, lambda k: F.when(F.char_length(k) >= min_chars, _hash(k))).alias("hs"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """h, n_docs of the line keys found in at least ``min_docs`` documents."""
    return (_with_hashes(docs, max(min_chars, 1)).select(F.explode(F.array_distinct("hs")).alias("h"))
            .where(F.col("h").isNotNull()).groupBy("h").agg(F.count("*").alias("n_docs"))
            .where(F.col("n_docs") >= min_docs))


def _plan(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """row (the document), kept (its text), n_lines, n_dropped."""
    lines = (_with_hashes(docs, max(min_chars, 1))
             .select("doc_id", "t", F.posexplode("hs").alias("pos", "h")).where(F.col("h").isNotNull()))
    hot = frequent_lines(docs, min_docs, min_chars).select("h")
    gone = (lines.join(hot, "h", "left_semi").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"))
            .withColumnsRenamed({"doc_id": "_gone_id", "t": "_gone_t"}))
    own = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    joined = own.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_gone_id")) & (_hash(text) == F.col("_gone_t")), "left")
    split = F.split(text, "\n")
    places = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(
        F.array_except(places, F.col("gone")), lambda i: F.get(split, i)), "\n"))
    return joined.select("row", kept.alias("kept"), F.size(split).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``; ``n_chars`` follows the text where it is a column."""
    out, changed = _plan(docs, min_docs, min_chars), F.col("n_dropped") > 0
    own = {c: F.col("row").getField(c) for c in docs.columns}
    new = {"text": F.col("kept")}
    if "n_chars" in own:
        new["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(F.when(changed, new[c]).otherwise(x) if c in new else x).alias(c) for c, x in own.items()])


def digests(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    out = _plan(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    key = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, {key} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs})
SELECT doc_id, count(*)::bigint AS n_lines, (count(*) FILTER (WHERE f.key IS NOT NULL))::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""
