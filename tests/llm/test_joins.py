"""Sharding, line dedup, SimHash, decontamination, HTML and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import decontaminate, graph, html_text, line_dedup, sharding, simhash


def test_sharding(spark, corpus, corpus_rows, odd, none, odd_rows):
    for docs, source in ((corpus, corpus_rows), (odd, odd_rows)):
        rows = sharding.assign(docs).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in source)
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.assign(none).count() == 0
    sizes = Counter()
    for r in sharding.assign(corpus, bucket_units=20).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 8


def test_sharding_groups_stay_together(spark):
    rows = [(i, f"text number {i // 2} " * 20) for i in range(4000)]
    held = defaultdict(set)
    for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        held[rows[r["doc_id"]][1]].add(r["shard"])
    assert all(len(s) == 1 for s in held.values())


@pytest.mark.parametrize("n", [50, 200, 1000])
def test_small_tables_keep_groups(spark, n):
    """In small tables, where a few rows are a large share, equal texts stay in one shard too."""
    rng = np.random.default_rng(n)
    rows = [(i, f"text {rng.integers(n // 4)} " * int(1 + i % 3)) for i in range(n)]
    rows = [(i, t if i % 9 else "one text of a group that is a ninth of the rows") for i, t in rows]
    held = defaultdict(set)
    for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        held[rows[r["doc_id"]][1]].add(r["shard"])
    assert all(len(s) == 1 for s in held.values())


def test_given_tables_keep_groups(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        texts, held = {r["doc_id"]: r["text"] for r in docs.collect()}, defaultdict(set)
        for r in sharding.op2_sharding(spark, folder).collect():
            held[texts[r["doc_id"]] or ""].add(r["shard"])
        assert all(len(s) == 1 for s in held.values())


def shard_sums(docs):
    sizes, rows = Counter(), Counter()
    for r in sharding.assign(docs).collect():
        sizes[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
    return [sizes[s] for s in range(8)], [rows[s] for s in range(8)]


def test_sharding_without_ids(spark):
    """Copies without a doc_id, or with one in common, are dealt like others."""
    for own in (None, 7):
        rows = [(own, "fourteen bytes") for _ in range(6000)] + [(i, f"{i:03d}") for i in range(2000)]
        for got in shard_sums(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)):
            assert max(got) - min(got) <= 0.01 * sum(got) / 8


def test_sharding_in_buckets(spark):
    """5,000 groups go through the buckets and come out as even as by one greedy over all."""
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(1, 400)) + f" {i}") for i in range(5000)]
    sizes, counts = shard_sums(spark.createDataFrame(rows, "doc_id long, text string"))
    demand = np.array([[len(t) + 1, 2, 1] for _, t in rows], dtype=float)
    whole = demand.sum(axis=0)
    placed = sharding.place(demand / whole, np.full((8, 3), 1 / 8), sharding.largest_first(demand / whole, list(range(5000))))
    greedy = [np.bincount(placed, weights=demand[:, k], minlength=8) for k in (0, 2)]
    for got, best in ((sizes, greedy[0]), (counts, greedy[1])):
        assert max(got) - min(got) <= max(best) - min(best) + 0.01 * sum(got) / 8


def brute_place(demand, capacity, order):
    out = {}
    for i in order:
        fits = [s for s in range(len(capacity)) if all(c >= d - 1e-12 for c, d in zip(capacity[s], demand[i], strict=True))]
        best = max(fits or range(len(capacity)), key=lambda s: (sum(c * d for c, d in zip(capacity[s], demand[i], strict=True)), -s))
        out[i] = best
        capacity[best] = [c - d for c, d in zip(capacity[best], demand[i], strict=True)]
    return [out[i] for i in range(len(demand))]


def test_place_is_the_greedy():
    rng = np.random.default_rng(0)
    d = rng.integers(1, 50, (60, 3)) / 1024
    order = sharding.largest_first(d, list(range(60)))
    assert sharding.place(d, np.full((4, 3), 0.5), order).tolist() == brute_place(d.tolist(), [[0.5] * 3 for _ in range(4)], order)


# ---- line dedup ----


def brute_lines(rows, least):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    docs = [(d, (t or "").split("\n")) for d, t, *_ in rows]
    counts = Counter(k for _, lines in docs for k in {key(x) for x in lines} if k)
    out = []
    for d, lines in docs:
        kept = [x for x in lines if counts[key(x)] < least]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 256])
def test_lines(corpus, corpus_rows, odd, none, odd_rows, hot, monkeypatch):
    # With 1 no key or text is hot; with 256 most of these small tables' keys are.
    monkeypatch.setattr(line_dedup, "HOT", hot)
    for docs, source, least in ((corpus, corpus_rows, 10), (corpus, corpus_rows, 2), (odd, odd_rows, 2)):
        got = line_dedup.dedup_lines(docs, least)
        lines, dropped = got.columns[-2:]
        assert Counter((r["doc_id"], r["text"], r[lines], r[dropped]) for r in got.collect()) == brute_lines(source, least)
    assert set(odd.columns) < set(line_dedup.dedup_lines(odd).columns) and lines == "n_lines_"
    assert {r["n_lines"] for r in line_dedup.dedup_lines(odd).collect()} == {"clash"}
    assert line_dedup.dedup_lines(none, 10).count() == 0


def test_many_lines(spark):
    """Keys on both sides of the limit in many shards, one line and one text in a third of all rows."""
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(f"Line {int(rng.integers(2000))} " for _ in range(8)) + ("\neverywhere" if i % 3 == 0 else "")) for i in range(2000)]
    rows += [(2000 + i, "a hot text\nof two lines") for i in range(1000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == brute_lines(rows, 10)


def index_rows(index):
    counts = {bytes(r["key"]): r["docs"] for r in index.counts.collect()}
    keys, found = set(), {}
    for r in index.filters.collect():
        raw = bytes(r["keys"])
        own = [raw[i : i + 16] for i in range(0, len(raw), 16)]
        keys |= set(own)
        found[r["shard"]] = line_dedup.Shard(bytes(r["filter"]), raw)
        assert found[r["shard"]].filter.contains(line_dedup.as_words(own)).all() and found[r["shard"]].holds(own).all()
        assert (found[r["shard"]].filter.table > 0).sum() == len(own)
    assert keys == {k for k, n in counts.items() if n >= index.min_docs}
    return counts, keys


def test_index_is_reversible(spark, corpus):
    """Insertions and deletions change counts and filters alike, and a deletion undoes an insertion."""
    a, b = corpus.filter("doc_id % 3 = 0"), corpus.filter("doc_id % 3 <> 0")
    first = line_dedup.build_index(b, 3)
    both = line_dedup.insert_documents(first, a)
    assert index_rows(both) == index_rows(line_dedup.build_index(corpus, 3))
    assert index_rows(line_dedup.delete_documents(both, a)) == index_rows(first)
    assert index_rows(line_dedup.delete_documents(first, corpus)) == ({}, set())
    # Documents that the index has not seen lose what is common in it, and nothing else.
    new = spark.createDataFrame([(1, "never seen\nshared line\nSHARED LINE")], "doc_id long, text string")
    assert line_dedup.dedup_lines(new, index=both).first()["text"] == "never seen"


def test_cuckoo_filter():
    keys = line_dedup.as_words([xxhash.xxh3_128_digest(str(i)) for i in range(5000)])
    held = line_dedup.CuckooFilter.build(keys)
    assert held.contains(keys).all() and (held.table > 0).sum() == 5000
    others = line_dedup.as_words([xxhash.xxh3_128_digest(f"x{i}") for i in range(20000)])
    assert held.contains(others).mean() < 0.002
    held.delete(keys[:2500])
    assert held.contains(keys[2500:]).all() and held.contains(keys[:2500]).mean() < 0.01
    full = line_dedup.CuckooFilter(600)
    full.insert(keys[: full.table.size * 9 // 10])
    assert full.contains(keys[: full.table.size * 9 // 10]).all()
    with pytest.raises(OverflowError):
        line_dedup.CuckooFilter(1).insert(keys[:100])


# ---- simhash ----


def brute_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("hot", [1, 256])
def test_simhash(corpus, corpus_rows, odd, none, odd_rows, hot, monkeypatch):
    # With 1 no fingerprint is hot; with 256 all of these small tables' are.
    monkeypatch.setattr(simhash, "HOT", hot)
    for docs, source in ((corpus, corpus_rows), (odd, odd_rows)):
        fps = [(d, brute_fingerprint(t or "")) for d, t, *_ in source]
        root = brute_components([f for _, f in fps])
        least = defaultdict(list)
        for d, f in fps:
            if d is not None:
                least[root[f]].append(d)
        wanted = Counter((d, f, min(least[root[f]], default=None)) for d, f in fps)
        got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
        assert got == wanted
    assert simhash.near_duplicates(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_manhattan_is_a_lower_bound(a, b):
    def unary(x):
        return ((x | x >> 1) & simhash.EVEN) | ((x & x >> 1) & simhash.EVEN) << 1

    counts = lambda x: [(x >> 2 * s & 1) + (x >> 2 * s + 1 & 1) for s in range(32)]
    manhattan = sum(abs(p - q) for p, q in zip(counts(a), counts(b), strict=True))
    assert (unary(a) ^ unary(b)).bit_count() == manhattan <= (a ^ b).bit_count()


@pytest.mark.parametrize("groups", [4, 5, 6, 8])
def test_links_connect_all(spark, groups):
    """What the links connect is what all pairs within 3 bits connect, crowded families included, with few links."""
    rng = np.random.default_rng(groups)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    flips = lambda b, n: b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False))
    chain = [base[0]]
    for _ in range(40):
        chain.append(flips(chain[-1], 3))
    family = [flips(base[1], int(rng.integers(1, 3))) for _ in range(150)]
    fps = sorted({simhash.signed(x % 2**64) for x in [*base, *[flips(b, n) for b in base for n in (1, 2, 3, 4)], *chain, *family, 0, 2**64 - 1, 7, 15]})
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), groups).collect()]

    def roots(pairs):
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        return {f: find(f) for f in fps}

    every = [(a, b) for i, b in enumerate(fps) for a in fps[:i] if ((a ^ b) % 2**64).bit_count() <= 3]
    assert roots(got) == roots(every)
    assert len(got) < len(every)


def test_dense_families(spark, monkeypatch):
    """Fingerprints that differ in 16 bits: pairs met grow with their number, not with its square, and links still connect all."""
    met = Counter()
    joined = simhash._met

    def counted(cells, sizes, radius):
        met[n] += sizes.agg(F.sum(F.col("members") * F.col("members"))).first()[0] or 0
        return joined(cells, sizes, radius)

    monkeypatch.setattr(simhash, "_met", counted)
    rng = np.random.default_rng(5)
    places = [int(x) for x in rng.choice(64, 16, replace=False)]
    base = int(rng.integers(0, 2**63))
    for n in (1000, 2000, 4000):
        some = rng.choice(2**16, n, replace=False)
        fps = [simhash.signed((base ^ sum(1 << places[k] for k in range(16) if x >> k & 1)) % 2**64) for x in some.tolist()]
        got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()}
        a, b = np.array(sorted(got)).T
        assert (np.bitwise_count(a ^ b) <= 3).all()
        x = np.array(fps)
        parent = dict(zip(fps, fps, strict=True))

        def find(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for p, q in got:
            parent[find(p)] = find(q)
        for f in fps[:300]:
            assert {find(int(y)) for y in x[np.bitwise_count(x ^ f) <= 3]} == {find(f)}
    # In one grid of four groups it were 3, 12 and 47 million; no row of a cell meets more than DENSE others.
    assert met[1000] < 300_000 and met[4000] < 2_000_000


@pytest.mark.parametrize("dense", [1, 3])
def test_finest_grids(corpus, corpus_rows, dense, monkeypatch):
    """Nearly all cells too large: every level is gone through, and components stay right."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    fps = [(d, brute_fingerprint(t or "")) for d, t in corpus_rows]
    root = brute_components([f for _, f in fps])
    least = {}
    for d, f in fps:
        least[root[f]] = min(d, least.get(root[f], d))
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(corpus).collect()} == {(d, least[root[f]]) for d, f in fps}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_drop_near_copies(spark, odd, none, odd_rows):
    rows = [(i, "one two three four five six seven eight nine ten") for i in range(5)] + [(9, "something else entirely to be kept here today")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 9]
    kept = simhash.drop_near_copies(odd).collect()
    assert sum(r["text"] == "same same" for r in kept) == 1 and sum(not r["text"] for r in kept) == 1
    assert set(kept[0].asDict()) == set(odd.columns)
    assert simhash.drop_near_copies(none).count() == 0


def test_stage_drops_all_similar_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        text = [words[k] for k in rng.integers(0, 3000, int(rng.integers(60, 300)))]
        rows.append((i, " ".join(text)))
        for c in range(int(rng.integers(0, 4))):
            copy = list(text)
            for k in rng.integers(0, len(copy), int(rng.integers(1, 9))):
                copy[k] = "changed"
            rows.append((1000 + 10 * i + c, " ".join(copy)))
    rows += [(5000 + i, "all of these words are common to many texts " + " ".join(words[k] for k in rng.integers(0, 3000, 6))) for i in range(60)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: grams(t) for d, t in rows}
    pairs = [(a, b) for i, (a, _) in enumerate(rows) for b, _ in rows[:i] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    bits = {d: simhash.fingerprint(t.encode(), 5) for d, t in rows}
    assert sum((bits[a] ^ bits[b]).bit_count() > 8 for a, b in pairs) > 5
    pairs += [(a, b) for i, (a, _) in enumerate(rows) for b, _ in rows[:i] if (bits[a] ^ bits[b]).bit_count() <= 3]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert got == sorted(d for d in parent if find(d) == d)


# ---- decontamination ----


def substring_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("ab ", max_size=40))
def test_myers(pattern, text):
    want = substring_distance(pattern, text)
    got = decontaminate.myers(decontaminate.masks(pattern), len(pattern), text, len(pattern))
    if got is None:
        assert want == len(pattern) or not text
    else:
        assert got[0] == want and substring_distance(pattern, text[: got[1]]) == want


def test_leaks(spark, odd, none):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijk"), int(rng.integers(2, 8))))
    items = [(i if i != 11 else None, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (52, "...")]
    rows = []
    for d in range(60):
        text = list(" ".join(word() for _ in range(60)))
        if d % 2:
            passage = list(items[d % 12][1])
            for _ in range(d % 5 * 3):
                at = int(rng.integers(len(passage)))
                if rng.random() < 0.5:
                    passage[at] = "z"
                else:
                    del passage[at]
            text[20:20] = [" ", *passage, " "]
        rows.append((d, "".join(text).title()))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = set()
    for d, t in rows:
        for i, b in items[:12]:
            pattern = decontaminate.normal(b)
            k = substring_distance(pattern, decontaminate.normal(t))
            if k <= int(len(pattern) * decontaminate.ERROR_RATE):
                wanted.add((d, i, k))
    assert wanted
    for size in (decontaminate.BLOCK_CHARS, 300):
        got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench, block_chars=size).collect()}
        assert got == wanted
        kept = decontaminate.drop_contaminated(docs, bench, block_chars=size).collect()
        assert {r["doc_id"] for r in kept} == {d for d, _ in rows} - {d for d, _, _ in wanted}
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == 10


# ---- html ----


def test_blocks():
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="x">menu</a></nav>'
        '<div class="ad">buy &amp; go</div><article><h1>Head\n line</h1><p><b>Bo</b>ld &lt;x&gt;<br>next<p>two'
        '<aside>side</aside><section class="comments">c1</section></article><p>open</p><footer>f</footer>'
    )
    got = html_text.blocks_of(page)
    assert got == [
        (2, "menu"), (2, "buy & go"), (1, "Head line"), (1, "Bold <x>"), (1, "next"), (1, "two"), (2, "side"), (2, "c1"), (0, "open"), (2, "f"),
    ]
    assert html_text.blocks_of("a <!-- x <p> --> b<p") == [(0, "a b")]
    assert html_text.blocks_of('<form class="x"><div>all</div><nav>m</nav><form>of it</form></form>') == [(0, "all"), (2, "m"), (0, "of it")]
    assert html_text.blocks_of("<form>search</form><p>text</p>") == [(2, "search"), (0, "text")]
    assert html_text.blocks_of('<article>a<article class="comment-body x">c</article></article><article class="has-comments">b</article>') == [(1, "a"), (2, "c"), (1, "b")]
    assert html_text.blocks_of('<p title="a>b">c</p><p title="never closed>d</p><p>e</p>') == [(0, "c"), (0, "d"), (0, "e")]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("1 < 2 and 3 > 2") == [(0, "1 < 2 and 3 > 2")]


def brute_repeated(tokens, page, least):
    seen = defaultdict(set)
    for i in range(len(tokens) - least + 1):
        seen[tuple(tokens[i : i + least])].add(page[i])
    out = [False] * len(tokens)
    for i in range(len(tokens) - least + 1):
        if len(seen[tuple(tokens[i : i + least])]) > 1:
            out[i : i + least] = [True] * least
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=5), st.integers(1, 5))
def test_suffix_array(streams, least):
    tokens, page = [], []
    for p, s in enumerate(streams):
        tokens += [*s, -1 - p]
        page += [p] * (len(s) + 1)
    got = html_text.repeated_tokens(np.array(tokens, dtype=np.int64), np.array(page, dtype=np.int64), least).tolist()
    assert got == brute_repeated(tokens, page, least)


def test_long_broken_page():
    import time

    began = time.time()
    for page in ("<a b='" * 40_000, "<p title=\"x>y" * 40_000, "<div>" * 40_000 + "</span>" * 40_000, "<script>" * 20_000, "<!--" * 40_000):
        html_text.blocks_of(page)
    assert time.time() - began < 20


def brute_host(pages, least=5):
    """The texts of one host's pages (id, blocks), from the definitions, whatever their number."""
    def runs(words):
        return [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]

    place_text = {i: tuple((p, t) for p, t in blocks if p != 2) for i, blocks in pages}
    inside, together = defaultdict(set), defaultdict(set)
    for i, blocks in pages:
        words = []
        for p, t in blocks:
            if p != 1:
                words += t.split()
                for r in runs(t.split()):
                    inside[r].add((i, place_text[i]))
        for r in runs(words):
            together[r].add((i, place_text[i]))
    twice = lambda held: {r for r, x in held.items() if len({i for i, _ in x}) > 1 and len({c for _, c in x}) > 1}
    inside, together = twice(inside), twice(together)
    out = {}
    for i, blocks in pages:
        words, spans = [], []
        for p, t in blocks:
            spans.append((len(words), len(words) + (len(t.split()) if p != 1 else 0)))
            words += t.split() if p != 1 else []
        whole = [any(tuple(words[k : k + least]) in together for k in range(max(0, j - least + 1), j + 1)) for j in range(len(words))]
        kept = []
        for (p, t), (a, b) in zip(blocks, spans, strict=True):
            w = t.split()
            if p == 0 and not all(whole[a:b]):
                w = [x for j, x in enumerate(w) if not any(tuple(w[k : k + least]) in inside for k in range(max(0, j - least + 1), j + 1))]
            elif p == 0:
                w = []
            kept.append(w)
        article = {k for k, (p, _) in enumerate(blocks) if p == 1}
        open_ = {k for k, (p, _) in enumerate(blocks) if p == 0 and kept[k]}
        if article and sum(len(kept[k]) for k in open_) <= sum(len(blocks[k][1].split()) for k in article):
            open_ = set()
        out[i] = " ".join(" ".join(kept[k]) for k in range(len(blocks)) if k in article | open_)
    return out


@pytest.mark.parametrize("n", [60, 700])
def test_whole_host(spark, n):
    """Hosts of one and of several shards give what the definitions give over the whole host; runs bear on pages with an article."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(8) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        pick = lambda: shared[int(rng.integers(len(shared)))]
        article = f"<article><h2>menu of the site</h2><p>teaser {text(int(rng.integers(2, 60)))}</p><p>{pick()}</p></article>" if i % 12 else ""
        body = f"<div>{text(int(rng.integers(1, 50)))} {pick()} {word()}</div><div>{pick()}</div><ul><li>one</li><li>two</li><li>three</li><li>four</li><li>five</li></ul>"
        rows.append((i, "http://a.example/x", f"<nav>{pick()}</nav>{article}{body}"))
    rows += [(n + k, "http://a.example/x", rows[k][2]) for k in range(10)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    wanted = brute_host([(i, html_text.blocks_of(h)) for i, _, h in rows])
    assert got == wanted
    both = [i for i in range(n) if i % 12 and got[i].count(" ") > 0]
    # What all articles of a host have is the article's own text, on nine pages as on hundreds.
    assert all("menu of the site" in got[i] for i in both)
    assert any(set(got[i].split()) - set(rows[i][2].split("</article>")[0].replace("<", " ").replace(">", " ").split()) for i in both)


def test_frames():
    """Frames named after what stands beside the text, headlines and captions of articles, and what is marked for good."""
    both = lambda page: [(p, t) for p, t in html_text.blocks_of(page) if p != html_text.MARKED]
    article, open_ = html_text.ARTICLE, html_text.OPEN
    assert both('<div class="layout with-sidebar"><main><p>Main words</p></main><div class="sidebar">side</div></div>') == [(article, "Main words")]
    assert both('<div id="page-header-wrap"><article><p>Words</p></article></div>') == [(article, "Words")]
    assert both('<div class="sidebar"><article>In a sidebar frame</article></div>') == [(article, "In a sidebar frame")]
    assert both('<div class="has-footer"><p>All of it</p></div>') == [(open_, "All of it")]
    assert both('<div class="has-footer"><p>Less</p></div><p>Open text</p>') == [(open_, "Open text")]
    page = '<article><header><nav>Menu</nav><h1>Headline</h1><p>By line</p></header><figure class="share-image"><figcaption>Caption</figcaption></figure><p>Text</p><div class="related-posts">More</div><div class="ad">Ad</div></article>'
    assert both(page) == [(article, "Headline"), (article, "Caption"), (article, "Text")]
    assert both("<nav><article>Teaser</article></nav><footer><main>x</main></footer><p>Rest</p>") == [(open_, "Rest")]
    assert both('<div class="comments"><article>Said</article></div><article class="comment-body">Too</article><p>Rest</p>') == [(open_, "Rest")]
    assert both("<form><div class=\"with-menu\"><p>In a form</p></div></form>") == [(open_, "In a form")]
    assert both("<form>Search</form><p>Rest</p>") == [(open_, "Rest")]


@pytest.mark.parametrize("n", [9, 10, 11])
def test_articles_stay_whole(spark, n):
    """A block that the articles of all pages have stays, whatever their number."""
    rows = [(i, "http://a.example/x", f"<article><p>A notice on every page</p><p>own words {i} of this page</p></article>") for i in range(n)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"A notice on every page own words {i} of this page" for i in range(n)}


def test_extraction(spark):
    boiler = "all rights reserved by the owner of this site"
    rows = [(i, "http://a.example/x", f"<body><p>{boiler}</p><p>unique words {i} of page number {i * 7}</p></body>") for i in range(600)]
    rows += [(1000, None, None), (1001, "http://b.example", ""), (1002, "http://b.example", f"<p>{boiler}</p>"), (1003, "http://c.example", "<article>" + boiler + "</article>"), (1003, "http://c.example", "<article>" + boiler + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = defaultdict(list)
    for r in html_text.extract_text(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == [f"unique words {i} of page number {i * 7}"] for i in range(600))
    assert got[1000] == got[1001] == [""] and got[1002] == [boiler] and got[1003] == [boiler] * 2
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_runs_across_shards(spark):
    # 1,000 pages are four shards; each passage stands on two pages only.
    rows = []
    for i in range(1000):
        passage = " ".join(f"p{i % 500}x{k}" for k in range(6))
        menu = "".join(f"<li>m{i % 500}y{k}</li>" for k in range(6))
        rows.append((i, "http://a.example/x", f"<ul>{menu}</ul><p>own{i} a{i} {passage} b{i}</p>"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own{i} a{i} b{i}" for i in range(1000)}


def test_copies_of_open_pages(spark):
    boiler = "all rights reserved by the owner of this site"
    # The copies lie in one shard on the first host, in several on the second.
    for n in (40, 700):
        rows = [(i, "http://a.example/x", f"<p>one story told twice or more with no article element</p><footer>{boiler}</footer>") for i in range(n)]
        rows += [(n + i, "http://a.example/x", f"<p>{boiler}</p><p>only{i} here{i}</p>") for i in range(3)]
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(got[i] == "one story told twice or more with no article element" for i in range(n))
        assert [got[n + i] for i in range(3)] == [f"only{i} here{i}" for i in range(3)]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = corpus_pipeline.read_table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test-stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before, name
            before = docs.count()
            last = docs
    assert docs.select("doc_id").distinct().count() == last.count()


def test_pipeline_odd(spark, sf, odd, none):
    """Nulls, repeated rows and columns that clash with those that the stages make: names and other values stay."""
    import corpus_pipeline

    clashes = [f.lower() for f in ("tox_score", "N_LINES", "n_dropped", "body", "salt", "gone", "fp", "row", "textloom_fp", "a.b", "id", "component_id")]
    wide = odd
    for name in clashes:
        wide = wide.withColumn(name, F.lit("clash")) if name not in odd.columns else wide
    for docs in (wide, wide.limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == columns
            docs = corpus_pipeline.materialize(docs, "test-odd")
        rows = docs.collect()
        assert all(r[c] == "clash" for r in rows for c in clashes)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
    assert none.count() == 0


def test_drop_near_copies_ties(spark):
    rows = [(1, "b c d", "x"), (1, "b c d", "y"), (None, "q r s", "x"), (None, "q r s", "z"), (7, None, "x"), (7, "", "y")]
    kept = set()
    for n in (1, 3, 6):
        got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(n)).collect()
        assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 7]
        kept.add(tuple(sorted((str(r["doc_id"]), r["fp"]) for r in got)))
    assert len(kept) == 1


def test_kept_digest(spark, sf):
    from textloom.llm.queries import QUERIES

    r = QUERIES["op3_line_dedup"](spark, sf).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
