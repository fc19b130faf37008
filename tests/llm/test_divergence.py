"""The divergence audit against whole sums over all terms and pairs."""

import random
import re
from collections import Counter

from folioloom.llm import divergence


def plain(rows, least_docs=3, ranks=200):
    docs = [((r["lang"] or ""), (r["source"] or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or "")))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in df.items() if n >= least_docs)
        count = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, words in mine:
            count[s].update({t: n for t, n in words.items() if t in set(kept)})
        whole = sum(count.values(), Counter())

        def share(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = share(whole), {s: share(c) for s, c in count.items()}
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, v string"


def table(spark, docs):
    return spark.createDataFrame([(k, d["text"], d["lang"], d["source"], -1, -1, "mine") for k, d in enumerate(docs)], SCHEMA)


def test_random_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    rng = random.Random(1)
    words = ["a", "B", "the", "The", "ÉTÉ", "été", "straße", "漢字", "x1y", "zz", *[f"w{chr(97 + k)}" for k in range(20)]]
    for n in (0, 1, 40, 150):
        docs = [
            {
                "text": rng.choice([None, "", "  12 34 ", *[" ".join(rng.choice(words[: rng.randrange(1, 30)]) for _ in range(rng.randrange(60))) for _ in range(9)]]),
                "lang": rng.choice(["en", "en", "fr", None, ""]),
                "source": rng.choice(["big", "big", "big", *[f"s{k}" for k in range(6)], None, "é", "Z"]),
            }
            for _ in range(n)
        ]
        assert rows_of(divergence.audit(table(spark, docs))) == plain(docs)


def test_no_kept_terms_one_source_and_ranks(spark):
    docs = [{"text": "only once", "lang": "xx", "source": s} for s in "ab"] + [{"text": " ".join(f"{c}{d}" for c in "abcdefgh" for d in "kl"), "lang": "yy", "source": "one"}] * 3
    docs += [{"text": " ".join([c] * k), "lang": "zz", "source": "left"} for k, c in enumerate("abcdefg", 1) for _ in range(3)] + [{"text": "q " * 5, "lang": "zz", "source": "right"}] * 3
    want = plain(docs, ranks=4)
    assert rows_of(divergence.audit(table(spark, docs), ranks=4)) == want
    assert ("xx", "a", "pair", "b", 0, 1) in want and not any(r[0] == "yy" and r[2] == "pair" for r in want)


def test_one_long_text_and_copies(spark):
    docs = [{"text": "lorem ipsum dolor " * 30_000, "lang": "la", "source": "s"}] + [{"text": "ipsum amet", "lang": "la", "source": "t"}] * 200 + [{"text": "amet", "lang": "la", "source": "u"}]
    assert rows_of(divergence.audit(table(spark, docs), least_docs=1)) == plain(docs, least_docs=1)
