"""PII by information-theoretic sanitisation.

Protected entities are the values found by four base patterns (e-mail, IP
address, card and phone number).  Corpus co-occurrence tells how strongly a term
reveals an entity: over documents, PMI(entity, term) against the entity's
own information content IC(entity) = log(N / n).  A term that stands in at least ``MIN_DOCS`` documents
that hold the entity, anywhere in their texts, with PMI / IC of
at least ``DISCLOSURE``, discloses the entity, and all its occurrences in every document that holds the entity
become spans of kind ``term``.  ``sanitise`` replaces base spans by their kind,
generalises terms that are numbers or names to ``[NUMBER]`` and ``[NAME]`` and
removes the others.  Documents without an entity stay as they are.

All counts are aggregates over whole texts of all documents; a document counts
an entity, a term and a pair once.  Documents that hold an entity keep the places of
their terms, so spans need no second look at the texts, and texts are never shuffled.
Only terms beside an entity that ``MIN_DOCS`` documents share are dealt out and counted with it.

Defined cases: null text is empty; base spans of a kind do not overlap, failing
matches are dropped without a retry; each row is a document, and rows with
equal id and text get the same spans; a null ``doc_id`` is a value; an empty
table gives no rows; other columns are not read (``sanitise`` keeps them).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from tillroll.llm.common import _WORD, chunks, fresh, stored, words

KINDS = ("email", "ip", "card", "phone")
MIN_DOCS, DISCLOSURE = 2, 0.9
_FLUSH = 200_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does; that is checked after the first digit, so the search can look for digits.
_IP = re.compile(r"[0-9](?<![0-9].)[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?<![0-9].)(?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each ``@``: the whole run of local characters before it, and the domain after it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and _LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((begin, m.end()))
            last = m.end()
        else:
            last = at + 1  # no local part reaches back over an @
        at = text.find("@", last)
    return found


def _small(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def contexts(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], dict[str, list[tuple[int, int]]]]:
    """The entities of a text, each once, and term -> places of the words outside all base spans; none without an entity."""
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    if not spans:
        return [], places
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    reach = []
    for _, b in taken:  # the furthest end so far, as spans of two kinds may overlap
        reach.append(max(b, reach[-1] if reach else 0))
    for m in _WORD.finditer(text):
        a, b = m.span()
        i = bisect_left(starts, b) - 1
        if i < 0 or reach[i] <= a:
            places[m[0].lower()].append((a, b))
    return list(dict.fromkeys(entity_of(kind, text[a:b]) for kind, a, b in spans)), places


def _find(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, stored: per document its spans, entities and terms; per task, in how many documents a term stands."""
    place = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    term = pa.struct([("term", pa.string()), ("places", pa.list_(place))])
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = {"doc_id": pa.int64(), "t": pa.int64(), "spans": pa.list_(span), "entities": pa.list_(pa.string()),
             "terms": pa.list_(term), "term": pa.string(), "n": pa.int64()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for cols, texts in chunks(batches):
            rows = []
            for doc_id, text in zip(cols["doc_id"], texts):
                spans = base_spans(text)
                entities, terms = contexts(text, spans)
                rows.append({"doc_id": doc_id, "t": _text_hash(text),
                             "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans],
                             "entities": entities,
                             "terms": [{"term": w, "places": [{"start": a, "end": b} for a, b in p]} for w, p in terms.items()]})
                for w in set(words(text)):
                    counts[w] += 1
            yield batch(rows)
            if len(counts) >= _FLUSH:
                yield batch([{"term": w, "n": n} for w, n in counts.items()])
                counts.clear()
        if counts:
            yield batch([{"term": w, "n": n} for w, n in counts.items()])

    schema = ("doc_id long, t long, spans array<struct<kind: string, start: long, end: long>>, entities array<string>, terms "
              "array<struct<term: string, places: array<struct<start: long, end: long>>>>, term string, n long")
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "pii")


def _text_hash(text: str) -> int:
    h = xxh64_intdigest(text)
    return h - 2 ** 64 if h >= 2 ** 63 else h


def _shared(found: DataFrame, min_docs: int) -> DataFrame:
    """entity, n_e of the entities that enough documents hold to have disclosing terms; stored, so that its size is known."""
    entities = found.where("term is null").select(F.explode("entities").alias("entity"))
    return stored(entities.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_docs), "pii-entities")


def _pairs(found: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, t, entity, term, places per document, shared entity in it and term; a pair is in no more documents than its entity."""
    return (found.where("term is null and size(entities) > 0").select("doc_id", "t", F.explode("entities").alias("entity"), "terms")
            .join(shared, "entity", "left_semi")
            .select("doc_id", "t", "entity", F.explode("terms").alias("x"))
            .select("doc_id", "t", "entity", "x.term", "x.places"))


def _disclosing(pairs: DataFrame, found: DataFrame, shared: DataFrame, min_docs: int, disclosure: float) -> DataFrame:
    """entity, term of the terms that reveal an entity."""
    total = found.where("term is null").count()
    n_term = found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n_t"))
    n_both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_b")).where(F.col("n_b") >= min_docs)
    pmi = F.log(F.col("n_b") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t").cast("double")))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    return (n_both.join(shared, "entity").join(n_term, "term")
            .where((ic > 0) & (pmi >= disclosure * ic)).select("entity", "term"))


def find(docs: DataFrame, min_docs: int = MIN_DOCS, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, t (hash of the text), spans (base), terms (places of disclosing terms) per row of ``docs``."""
    found = _find(docs)
    shared = _shared(found, min_docs)
    pairs = _pairs(found, shared)
    telling = _disclosing(pairs, found, shared, min_docs, disclosure)
    # telling grows with the pairs: it is never broadcast
    terms = (pairs.join(telling.hint("merge"), ["entity", "term"]).select("doc_id", "t", F.explode("places").alias("place"))
             .groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("place")).alias("terms"))
             .withColumnsRenamed({"doc_id": "_id", "t": "_t"}))
    base = found.where("term is null").select("doc_id", "t", "spans")
    joined = base.join(terms, base["doc_id"].eqNullSafe(terms["_id"]) & (base["t"] == terms["_t"]), "left")
    return joined.select("doc_id", "t", "spans", F.coalesce("terms", F.array().cast("array<struct<start: long, end: long>>")).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    out = find(docs)
    written = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform("spans", lambda s: written(s["kind"], s)), ",")
    terms = F.array_join(F.transform("terms", lambda s: written(F.lit("term"), s)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.size("terms").cast("long").alias("n_term"),
                      F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                      F.concat_ws(",", F.when(F.size("spans") > 0, base), F.when(F.size("terms") > 0, terms)).alias("spans"))


def replaced(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int]]) -> str:
    """Base spans become ``[KIND]``, terms ``[NUMBER]``, ``[NAME]`` or nothing; of overlapping spans the first, then longest, counts."""
    parts, last = [], 0
    for a, b, kind in sorted([(a, b, k) for k, a, b in spans] + [(a, b, "term") for a, b in terms], key=lambda s: (s[0], -s[1])):
        if a < last:
            if b > last:  # the rest of an overlapping span goes too
                last = b
            continue
        value = text[a:b]
        word = f"[{kind.upper()}]" if kind != "term" else "[NUMBER]" if value.isdigit() else "[NAME]" if value[0].isupper() else ""
        parts += [text[last:a], word]
        last = b
    return "".join([*parts, text[last:]])


def sanitise(docs: DataFrame, min_docs: int = MIN_DOCS, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with sanitised ``text`` (null stays null); rows meet their span lists by id and text hash."""
    def text_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_text_hash(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], [*names, hashed])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, spans, terms in zip(batch.column(at), batch.column(-2), batch.column(-1)):
                text, spans, terms = text.as_py(), spans.as_py(), terms.as_py()
                new.append(text if not spans and not terms else replaced(
                    text, [(s["kind"], s["start"], s["end"]) for s in spans], [(t["start"], t["end"]) for t in terms]))
            columns = list(batch.columns[:-2])
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    names, hashed = docs.columns, fresh(docs, "_t")
    at = names.index("text")
    out = find(docs, min_docs, disclosure).where("size(spans) + size(terms) > 0").dropDuplicates(["doc_id", "t"])
    keyed = docs.mapInArrow(text_hash, StructType([*docs.schema, StructField(hashed, LongType())])).select(F.struct("*").alias("row"))
    joined = keyed.join(out, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row").getField(hashed) == F.col("t")), "left")
    lists = [F.col(c).alias(fresh(docs, f"_{c}")) for c in ("spans", "terms")]
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], *lists).mapInArrow(rewrite, docs.schema)
