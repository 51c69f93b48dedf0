"""Block-max WAND against exhaustive scoring; planted items are found, clean rows stay."""

import pickle
import random
from collections import Counter

import numpy as np
from edges import documents, nothing, words

from graphloom.llm.decontaminate import MAX_ITEM_WORDS, THRESHOLD, Benchmark, drop_leaky, find_leaks


def test_wand_retrieves_just_what_exhaustive_scoring_does():
    r = random.Random(5)
    items = [(k, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(5, 30))).encode()) for k in range(300)]
    index = Benchmark.of(items).shards[0]
    for _ in range(200):
        terms = sorted({index.terms[w] for w in (r.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(r.randint(1, 20))) if w in index.terms})
        total = np.zeros(len(index.items))
        for t in terms:
            for k, s in zip(*index.postings[t]):
                total[k] += s
        bound = index.maxima(np.array(terms, np.int64)).sum(axis=0)
        for threshold in (0.2, 0.5, 0.8):
            allowed = set(np.flatnonzero(bound >= threshold - 1e-4).tolist())
            got = dict(index.retrieve(terms, allowed, threshold))
            want = {k: s for k, s in enumerate(total) if s >= threshold - 1e-6}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def planted(spark):
    r = random.Random(6)
    items = [(k, f"What {' '.join(words(500 + k, 12))}? It is {' '.join(words(900 + k, 8))}.") for k in range(60)]
    items += [(60, None), (61, ""), (62, "short item"), (63, " ".join(words(77, MAX_ITEM_WORDS + 100)))]
    docs, want = [], set()
    for k in range(80):
        body = words(3000 + k, r.randint(0, 900))
        if k % 4 == 0:
            i = r.randrange(60)
            at = r.randint(0, len(body))
            body[at:at] = items[i][1].split()
            want.add((k, i))
        docs.append((k, " ".join(body)))
    docs += [(100, items[3][1].upper()), (101, items[4][1].split("?")[0] + "?"), (102, "has a short item in it"), (103, None), (104, ""), (105, items[63][1])]
    want |= {(100, 3), (102, 62), (105, 63)}
    schema = "id long, text string"
    return spark.createDataFrame(docs, schema).withColumnRenamed("id", "doc_id").repartition(3), spark.createDataFrame(items, schema).withColumnRenamed("id", "item_id"), want


def test_planted_items(spark):
    docs, items, want = planted(spark)
    got = find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["score"] >= THRESHOLD - 1e-6 and r["shingle_overlap"] >= 0.8 for r in got)
    left = drop_leaky(docs, items)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_shards_and_parts_change_nothing(spark, monkeypatch):
    from graphloom.llm import decontaminate

    docs, items, want = planted(spark)
    monkeypatch.setattr(decontaminate, "SHARD", 10)
    monkeypatch.setattr(decontaminate, "SEGMENT", 3)
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 2000)
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    assert got == want


def test_long_items_are_judged_whole():
    """No remainder of a long item counts as the item; the whole one is found wherever it lies."""
    r = random.Random(8)
    for n in (MAX_ITEM_WORDS + 1, MAX_ITEM_WORDS + 44, 2 * MAX_ITEM_WORDS + 1, 5 * MAX_ITEM_WORDS):
        item = [f"i{n}_{k}" for k in range(n - 1)] + ["the"]
        bench = Benchmark.of([(1, " ".join(item).encode()), (2, b"a short item of seven words here")])
        rest = words(n, 700)
        held = lambda part: [k for k, *_ in bench.leaks(" ".join(rest[:350] + part + rest[350:]).encode())]
        assert held(["the"]) == [] and held(item[-44:]) == [] and held(item[: n // 2]) == []
        assert held(item) == [1] and held("a short item of seven words here".split()) == [2]
        for at in r.sample(range(700), 5):
            assert [k for k, *_ in bench.leaks(" ".join(rest[:at] + item + rest[at:]).encode())] == [1]


def test_parts_score_by_the_whole_test_set(spark, monkeypatch):
    from graphloom.llm import decontaminate

    docs, items, want = planted(spark)
    cut = items.where("item_id < 20").selectExpr("item_id + 500 as doc_id", "regexp_replace(text, ' [^ ]+$', '') as text")
    rows = lambda: {tuple(round(x, 9) for x in r) for r in find_leaks(docs.unionByName(cut), items).collect()}
    whole = rows()
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 4000)
    assert rows() == whole and {r[:2] for r in whole} == want | {(k + 500, k) for k in range(20)}
    assert any(r[2] < 0.99 for r in whole)


def hard_items() -> list[tuple[int | None, str | None]]:
    """Templated items that differ in one rare word, long ones, repeated ids and texts, nulls."""
    template = "% : please name the capital of this country and say how many people live there in all . it is the one and only"
    items = [(k, template.replace("%", f"rare{k}")) for k in range(150)]
    items += [(200 + k, " ".join(words(60 + k, n))) for k, n in enumerate((3, 5, 6, 9, 40, MAX_ITEM_WORDS - 1, MAX_ITEM_WORDS + 1, 3 * MAX_ITEM_WORDS))]
    items += [(200, " ".join(words(99, 30))), (300, items[0][1]), (301, items[0][1]), (None, " ".join(words(98, 25))), (None, None), (302, ""), (303, "?? !!")]
    return items


def hard_documents(items) -> list[tuple[int, str | None]]:
    r, out = random.Random(11), [(0, None), (1, ""), (2, "please name the capital")]
    for k, (_, text) in enumerate(items):
        body = words(4000 + k, r.choice((0, 30, 400)))
        own = (text or "").split()
        change = r.randrange(5)
        if change == 1:  # the rare word goes
            own = [w if not w.startswith("rare") else "spain" for w in own]
        elif change == 2 and len(own) > 8:  # a tenth of the words at one end goes
            own = own[len(own) // 10 :]
        elif change == 3:  # a few words come in
            at = len(own) // 2
            own[at:at] = words(k, len(own) // 10)
        elif change == 4:  # half of it is no leak
            own = own[: len(own) // 2]
        at = r.randint(0, len(body))
        out.append((10 + k, " ".join(body[:at] + own + body[at:]).upper() if k % 7 == 0 else " ".join(body[:at] + own + body[at:])))
    return out


def brute(docs, items) -> set[tuple]:
    """Every item against every passage of every document, by the overlaps alone."""
    from graphloom.llm.decontaminate import OVERLAP, SHINGLE, Item, Stats, _held, length_class, shingles

    whole = [i for k, t in items if t is not None and (i := Item.of(k, t.encode()))]
    longest = Stats.of(whole).longest
    out = set()
    for d, text in docs:
        w = (text or "").lower().encode().split()
        held = shingles(w)
        for i in whole:
            n = len(i.words)
            some = shingles(list(i.words))
            if n < SHINGLE:
                if not any(tuple(w[j : j + n]) == i.words for j in range(len(w) - n + 1)):
                    continue
            elif len(some & held) < OVERLAP * len(some):
                continue
            size = longest[length_class(n)]
            stride = max(32, size + size // 4)
            for at in range(0, len(w), stride):
                near = Counter(w[at : at + 2 * stride])
                if _held(i.question, near) >= OVERLAP and _held(i.answer, near) >= OVERLAP:
                    out.add((d, i.item_id))
    return out


def test_every_leak_that_the_overlaps_confirm_is_found(spark, monkeypatch):
    from graphloom.llm import decontaminate

    items = hard_items()
    docs = hard_documents(items)
    want = brute(docs, items)
    assert len(want) > 10_000  # a template without its rare word stands for all of them
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    for shard, size in ((1024, 1 << 24), (7, 1 << 24), (50, 3000)):
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", size)
        got = [(r["doc_id"], r["item_id"]) for r in find_leaks(d, i).collect()]
        assert set(got) == want


def test_an_index_takes_a_bounded_multiple_of_its_text():
    r = random.Random(4)
    common = words(1, 2000)
    items = [(k, " ".join(r.choice(common) if r.random() < 0.7 else f"w{r.randrange(50_000)}" for _ in range(30)).encode()) for k in range(4096)]
    assert len(pickle.dumps(Benchmark.of(items))) < 12 * sum(len(t) for _, t in items)


def test_edges(spark):
    items = spark.createDataFrame([(1, "nothing of this is in there at all, is it? no it is not")], "item_id long, text string")
    df = documents(spark)
    assert find_leaks(df, items).collect() == [] and drop_leaky(df, items).count() == df.count()
    assert find_leaks(nothing(spark), items).collect() == []
    assert find_leaks(df, items.where("false")).collect() == [] and drop_leaky(df, items.where("false")).count() == df.count()
