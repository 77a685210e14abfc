import random
import re

from conftest_llm import lower

from rivulet.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    """(n_words, n_hit, sorted item names) of each text."""
    windows: dict = {}
    for ident, text in items:
        w = WORD.findall(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(ident))
    lengths = {len(k) for k in windows}
    out = []
    for text in docs:
        w, hit, names = WORD.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(spark, docs, items):
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in D.contamination(a, b).collect()}
    return [got[i] for i in range(len(docs))]


def test_every_window_is_found(spark, corpus):
    draw = random.Random(2)
    spoken = [t for t in corpus if t and len(t.split()) > 30]
    items = []
    for i in range(60):
        w = draw.choice(spoken).split()
        at, n = draw.randrange(len(w)), draw.choice([1, 2, 5, 12, 13, 14, 20, 40])
        items.append((i, " ".join(w[at : at + n]).upper() + "!"))
    items += [(90, None), (91, ""), (92, "... !!"), (93, "never seen words here at all"), (93, items[0][1]), (None, items[1][1])]
    docs = corpus + [f"before, {items[k][1]} - after" for k in range(20)]
    assert run(spark, docs, [(i if i is not None else None, t) for i, t in items]) == brute(docs, [("null" if i is None else i, t) for i, t in items])


def test_spans_that_break_off(spark):
    w = [f"t{i}" for i in range(40)]
    docs = [" ".join(w[:12]), " ".join(w[:13]), " ".join(w[5:25]), " ".join(w[:13] + ["x"] + w[14:27]), " ".join(["x"] * 300 + w[:13])]
    items = [(1, " ".join(w))]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [g[1] for g in got] == [0, 13, 20, 26, 13] and [g[3] for g in got] == [False, True, True, True, False]


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (None, "c d e", "m"), (5, None, "n")], "doc_id long, text string, hash string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("contaminated").isEmpty() and D.contamination(docs, none).count() == 4
    assert D.contamination(docs.limit(0), none).isEmpty()
    clean = D.decontaminate(docs, spark.createDataFrame([(1, "C D E")], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(r["hash"] for r in clean.collect()) == ["k", "k", "n"]


def test_short_item_inside_long_words(spark):
    docs, items = ["alpha beta", "alphabet a", "Äpfel alpha"], [(1, "alpha")]
    assert run(spark, docs, items) == brute(docs, items)
