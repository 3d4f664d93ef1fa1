"""The ten operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tonestream.llm import common, exact_dedup, html, mixing, near, packing, quality, simhash, suffix_dedup, token_counts, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
VOCAB = ["the", "a", "of", "Kind", "words,", "ünï", "日本", "x", "<|endoftext|>", "don't", "12", "#%", " ", "​", "\x1c", "é"]


def text(n):
    return "".join(random.choice(VOCAB) + random.choice([" ", " ", " ", "\n", "  ", "\t", ""]) for _ in range(n))


LONG = text(3000)
SOME = [None, "", " \n\t ", "one", "one two", "x" * 900, "ab " * 400, LONG, LONG, LONG + " more", *(text(random.randint(1, 400)) for _ in range(30))]
ROWS = [(i, t, "en", [None, "a", "b", "c"][i % 4], None) for i, t in enumerate(SOME)] + [(7, LONG, "en", None, None), (None, "no id here", None, "a", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("copies", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(t):
    return Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids


def test_packing(docs, none):
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        want[i] += 1
    for i, t, *_ in ROWS:
        if want[i] == 1:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == [*ids(t), 0]
            assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:], strict=False))
    assert sum(r.length for r in rows) == sum(len(ids(t)) + 1 for _, t, *_ in ROWS)
    assert packing.pack(none, PATH).collect() == []


def test_token_counts(docs, none):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH).collect())
    assert got == collections.Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t, *_ in ROWS)
    assert token_counts.count_tokens(none, PATH).collect() == []


def windows(words, n):
    seen = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            hit[i : i + n] = True
    return int(hit.sum())


def test_quality(docs, none):
    rows = quality.quality(docs, least_repeat=4).collect()
    want = collections.Counter()
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.split()]
        want[i, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), windows(words, 3), windows(words, 4)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    assert quality.quality(none).collect() == []


def test_quality_rejects_repeated_lines(spark):
    line = "this line stands here again\n"
    own = " ".join(f"w{i}" for i in range(70))
    rows = [(1, line * 6 + own), (2, own)]  # 30 of 100 words repeat: less than the base rule's half
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].base_failed and got[1].n_covered_words == 30 and not got[1].kept
    assert not got[2].base_failed and got[2].kept


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {r.source: r for r in rows}
    total = sum(r.size for r in rows)
    assert sum(r.target for r in by.values()) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r.source_size + 1e-6 for r in by.values())
    for s, r in by.items():
        assert abs(sum(x.taken for x in rows if x.source == s) - r.target) <= 2 * max(x.size for x in rows if x.source == s)
    assert mixing.mix(none).collect() == []


def test_mixing_stage_without_single_ids(spark):
    import corpus_pipeline

    rows = [(i, "w " * n, "en", "abc"[n % 3], 0) for i in (None, 3) for n in range(1, 40)] + [(3, "same " * 9, "en", "b", 0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    want = collections.Counter()
    for r in mixing.mix(df, row_key=F.md5(df["text"].cast("binary"))).collect():
        want[r.doc_id, r.row_key] += r.copies
    got = corpus_pipeline.mix_sources(spark, df, "")
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in got.collect()) == +want


@pytest.mark.parametrize("small", [0, 10_000])
def test_exact_dedup(docs, none, small, monkeypatch):
    monkeypatch.setattr(common, "SMALL", small)
    plain = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    want = collections.Counter()
    for p, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(sorted(members, key=lambda m: m != best)):
            want[m[2], best[2], len(members), k == 0, hashlib.sha256(p.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    kept = exact_dedup.kept(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_index_over_three_batches(spark):
    plain = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    rng = random.Random(4)
    index, seen = exact_dedup.DigestIndex(spark, "index_of_test", 4), []
    for k in range(3):
        new = [(10 * k + i, rng.choice(["ab", "a b", "a  b", "c", "d e", "de", None, " "])) for i in range(9)] + [(None, "c"), (10 * k, "only " + "abc"[k])]
        seen += new
        got = exact_dedup.exact_dedup(spark.createDataFrame(new, "doc_id long, text string"), index).collect()
        groups = collections.defaultdict(list)
        for i, t in seen:
            groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
        want = collections.Counter()
        for i, t in new:
            best = min(groups[plain(t)])
            want[i, best[3], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = collections.Counter(r.text_sha256 for r in got if r.kept)
        assert not kept or max(kept.values()) == 1
    assert index.rows().filter("fresh").groupBy("text_sha256").count().filter("count > 1").isEmpty()
    again = exact_dedup.DigestIndex(spark, "index_of_test", 4)  # goes on with what is there
    assert again.read().agg(F.sum("group_size")).first()[0] == len(seen)
    plan = exact_dedup.label(exact_dedup.digests(spark.createDataFrame([(1, "ab")] * 3, "doc_id long, text string")), index)
    assert plan.count() == 3
    index.drop()


def test_index_lies_in_the_shared_folder(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_folder", 2)
    assert index.location.startswith(spark.conf.get("spark.checkpoint.dir"))
    index.drop()


CLASH = "digest_ string, chars_ int, i_ int, k_ int, k_id_ int, copies_ int, rows_ int, copy_ int, row string, id string, digest string, node int, copies int, alike int, json string"


def test_stages_with_clashing_columns_and_awkward_rows(spark, none):
    import corpus_pipeline

    extra = ["x", 1, 2, 3, 4, 5, 6, 7, "r", "i", "d", 8, 9, 10, "j"]
    base = [(i, t, "en", [None, "a", "b"][i % 3], None) for i, t in enumerate([None, "", " ", *(f"w{i} " * 3 + " ".join(f"v{i}x{k}" for k in range(40)) for i in range(6))])]
    base += [base[4], base[4], (None, "a b c d e f", "en", "a", None), (None, "x y z", "en", "a", None), (1, "a b c d e f", "en", "a", None)]
    docs = spark.createDataFrame([(*r, *extra) for r in base], f"{SCHEMA}, {CLASH}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        if name == "exact_dedup":
            assert len(rows) == len({"".join((r[1] or "").split()) for r in base})
        if name == "near_dedup":
            texts = [r.text for r in rows]
            assert texts.count("a b c d e f") == 1 and texts.count("x y z") == 1 and texts.count(base[4][1]) == 1
        if name == "mixing":
            assert all((r.text or "").split() for r in rows)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []
    packed = corpus_pipeline.pack(spark, docs, "")
    assert packed.select(F.sum("length")).first()[0] == sum(len(ids(r[1])) + 1 for r in base)


@pytest.mark.parametrize("crowd", [2, 20_000])
def test_suffix_dedup(spark, docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(common, "SMALL", 0 if crowd == 2 else 10_000)
    seen = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    for _, b in raws:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    want = collections.Counter()
    for i, b in raws:
        hit = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                hit[k : k + 200] = True
        m = hit[: len(b)]
        want[i, len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) > 0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == want
    assert suffix_dedup.remove_repeats(none).collect() == []


def joined_on(spark, key, since):
    """Rows that joins on `key` alone made in executions from number `since` on."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, out = spark._jsparkSession.sharedState().statusStore(), 0
    listed = lambda x: [x.apply(i) for i in range(x.size())]
    for e in listed(store.executionsList()):
        if e.executionId() >= since:
            made = store.executionMetrics(e.executionId())
            for node in listed(store.planGraph(e.executionId()).allNodes()):
                if re.search(rf"Join \[{key}#\d+L\], \[{key}#\d+L\]", node.desc()):
                    out += sum(int(made.apply(m.accumulatorId()).replace(",", "")) for m in listed(node.metrics()) if m.name() == "number of output rows" and made.contains(m.accumulatorId()))
    return out


def test_copies_are_counted_before_joins(spark):
    one, made = LONG[:1500], []
    for copies in (20, 80):
        others = [(-i, f"{i} {one[: 250 * i]}") for i in range(1, 6)]
        df = spark.createDataFrame([(i, one) for i in range(copies)] + others, "doc_id long, text string")
        since = spark._jsparkSession.sharedState().statusStore().executionsCount()
        rows = suffix_dedup.remove_repeats(df).collect()
        assert len(rows) == copies + 5 and all(r.n_removed == r.n_bytes for r in rows if r.doc_id >= 0)
        made.append(joined_on(spark, "h", since))
    assert made[0] == made[1] > 0


def test_blockwise_suffix_order(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
    for trial in range(20):
        base = bytes(random.choices(b"ab" if trial % 2 else b"abcd \0", k=random.randint(1, 700)))
        t = base + base[random.randrange(len(base)) :] * (trial % 3)
        starts = np.array(sorted(random.sample(range(len(t)), random.randint(1, len(t)))))
        assert np.concatenate(list(suffix_dedup.suffix_buckets(t, starts))).tolist() == sorted(starts.tolist(), key=lambda i: t[i:])


def test_simhash(spark, none):
    base = text(60).split()
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 50, 2)]
    rows = [(i, t) for i, t in enumerate([*SOME, *near, *near[:3]])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def mark(t):
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))

    marks = {i: mark(t) for i, t in rows}
    root = {i: i for i in marks}
    for i in marks:
        for j in marks:
            if j < i and (marks[i] ^ marks[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{marks[i]:016x}", root[i]) for i in marks}
    assert simhash.near_duplicates(none).collect() == []


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 30, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 60).astype(np.uint64)))
    edges = simhash.forest(fps, np.ones(len(fps), bool), 3)
    assert len(edges) < len(fps)


def test_forest_counts_bit_63():
    base = np.uint64(0x1234_5678_9ABC_DEF0)
    for low in (1 << 0, 1 << 1 | 1 << 0, 1 << 40 | 1 << 3):
        fps = np.array([base, base ^ np.uint64(1 << 63 | low)], np.uint64).view(np.int64)
        assert simhash.forest(fps, np.ones(2, bool), 3) == [tuple(fps.tolist())]
    far = np.array([base, base ^ np.uint64(2**64 - 1)], np.uint64).view(np.int64)  # as a signed XOR -1, whose magnitude has one bit
    assert simhash.forest(far, np.ones(2, bool), 3) == []


def shingles(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_are_all_found(spark, none):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(rng.randint(3, 150)))) for i in range(60)]
    for i, t in rows[:40]:
        words = t.split()
        for k in range(4):  # similarities on both sides of 0.8
            own = list(words)
            for _ in range(rng.randint(1, 1 + len(words) // 40)):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            rows.append((100 + 10 * i + k, " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[0][1]), (903, rows[50][1] + " tail")]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = collections.defaultdict(set)
    for r, (i, t) in zip(root, rows, strict=True):
        want[r].add((i, hashlib.md5((t or "").encode()).hexdigest()))
    got = collections.defaultdict(set)
    for r in near.near_duplicates(df).collect():
        got[r.root].add((r.doc_id, r.digest))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert any(len(x) > 2 for x in want.values()) and near.kept(df).count() == len(want)
    assert near.kept(none).collect() == []


def test_near_copies_make_sets_of_compared_texts_only(spark):
    texts = ["a b c d e f g", "a b c d e f g h", "A b c d e f g", *(f"{i} x y z w v" for i in range(300))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    node = lambda t: near.node_of(near.shingle_set(t, 5, 42))
    wanted = spark.createDataFrame([(node(t), near.mark_of(t)) for t in texts[:2]], "node long, mark long")
    hits = near.hits(near.picked(wanted, "mark"), np.array([near.mark_of(t) for t in texts], np.int64))
    assert hits[:2].all() and hits.sum() < 20  # 2 of 303 and what shares a bit
    got = {r.node: set(r.hashes) for r in near.sets_of(docs, wanted, 5, 42, "text").collect()}
    assert got == {node(t): set(near.shingle_set(t, 5, 42).tolist()) for t in texts[:2]}


def test_near_copies_are_first_found_by_fingerprint(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), *(" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in rng.sample(range(400), 12)), *(text(40) for _ in range(5))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = {near.node_of(x): int(simhash.majority([x.view(np.uint64).tolist()])[0]) for x in (near.shingle_set(t, 5, 42) for t in texts)}
    root = {n: n for n in fps}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {n: x if r == y else r for n, r in root.items()}
    rounds, old = [], near.verified

    def verified(pairs, *args):
        rounds.append(pairs.collect())
        return old(pairs, *args)

    monkeypatch.setattr(near, "verified", verified)
    near.near_duplicates(docs).collect()
    got = {n: n for n in fps}
    for a, b in rounds[0]:
        x, y = sorted((got[a], got[b]))
        got = {n: x if r == y else r for n, r in got.items()}
    assert got == root and len(set(root.values())) < len(root)


def test_alike_but_unlinked_texts_make_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(150):  # similarities of about 0.6 to each other, crowded under the same shingles
        own = list(base)
        for _ in range(6):
            own[rng.randrange(200)] = f"new{rng.random()}"
        rows.append((i, " ".join(own)))
    made, old = [], near.verified

    def verified(pairs, *args):
        made.append(pairs.count())
        return old(pairs, *args)

    monkeypatch.setattr(near, "verified", verified)
    a, b = (near.shingle_set(t, 5, 42) for _, t in rows[:2])
    for size in (64, 32):  # folded or not, a sketch never shows more than the sets differ in
        differ = near.folded(near.sketch_of(a), size) ^ near.folded(near.sketch_of(b), size)
        assert 0 < np.bitwise_count(differ.view(np.uint64)).sum() <= len(np.setxor1d(a, b))
    sets = [shingles(t) for _, t in rows]
    linked = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near.near_duplicates(docs).count() == 150
    assert made[-1] <= 150 + 2 * linked  # before: nearly all of 11,175


@pytest.mark.parametrize("side", [7, 2_000])
def test_near_copies_left_over_make_forests_not_pairs(spark, monkeypatch, side):
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(100):  # similarities on both sides of 0.8, crowded under the same shingles
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(150)] = f"new{rng.random()}"
        rows.append((i, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    root = list(range(len(rows)))
    for i, j in links:
        root = [root[j] if r == root[i] else r for r in root]
    made, old = [], near.verified

    def verified(pairs, *args):
        made.append(pairs.collect())
        return old(pairs, *args)

    monkeypatch.setattr(near, "verified", verified)
    monkeypatch.setattr(near, "by_fingerprint", lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(near, "ROUNDS", 0)  # all is left to the last step
    monkeypatch.setattr(near, "SIDE", side)
    got = collections.defaultdict(set)
    for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.root].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted([i for i, r in enumerate(root) if r == k] for k in set(root))
    assert len(links) > 1500 and 1 < len(got) < 100
    if side > len(rows):  # before: every link and every near miss
        assert len(made[-1]) < 10 * len(rows)


def test_linked_components_are_not_compared_again():
    could = np.triu(np.ones((40, 40), bool), 1)
    label, tried = np.arange(40) // 20, []
    pairs = near.forest(could, label, lambda i, j: tried.append((i, j)) or (i, j) == (0, 22))
    assert pairs == [(0, 22)] and tried == [(0, 20), (0, 21), (0, 22)]


def test_near_copies_without_single_ids(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    copy = [*base[:50], "new", *base[51:]]
    other = [f"v{i}" for i in range(100)]
    rows = [(None, " ".join(base), "en", "a", 0), (None, " ".join(copy), "en", "a", 0), (5, " ".join(other), "en", "a", 0), (5, " ".join(other) + " tail", "en", "a", 0)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(str(r.doc_id) for r in left) == ["5", "None"]


def all_segments(scores):
    """Maximal segments by their definition: recursively, the best one, then both sides."""
    if not scores or max(scores) <= 0:
        return []
    sums = [(sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best = max(sums, key=lambda x: (round(x[0], 9), x[1]))
    _, _, a, b = best
    return all_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in all_segments(scores[b:])]


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(150):
        scores = [rng.choice([-3, -1.25, -0.5, 0.75, 1.5, 2.25]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == all_segments(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_toxicity(spark, none):
    rng = random.Random(3)
    clean = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [rng.choice(clean) for _ in range(60)]
        for k in range(0, 60, 12) if bad else ():
            words[k] = rng.choice(["idiotx", "moronx", "scumx"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "moronx")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(got[i].predicted == t and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, t in labels)
    assert got[1000].score == got[1001].score < 0.7 and not got[None].held_out
    assert toxicity.kept(docs, marks).columns == docs.columns
    assert toxicity.toxicity(none, marks).collect() == []
    assert {r.score for r in toxicity.toxicity(docs, marks.filter("toxic = 0")).collect()} == {0.0}


# ---- borders of blocks: in process, where the constants can be made small


def test_quality_over_block_borders(monkeypatch):
    rng = random.Random(9)
    docs_ = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    one = [quality.judge_block([d], 4) for d in docs_]
    whole_ = quality.judge_block(docs_, 4)
    for k in range(3):
        assert np.concatenate([o[k] for o in one]).tolist() == whole_[k].tolist()


def test_quality_verdict_by_brute_force(spark):
    """kept at the defaults: repeats of five words or more, covered share, longest one."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 300))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(base))
            base += base[a : a + rng.randint(3, 130)]
        rows.append((i, " ".join(base)))
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    verdicts = set()
    for i, t in rows:
        words = t.split()
        n, best = len(words), [0] * len(words)
        for a in range(n):
            for b in range(a + 1, n):
                k = 0
                while b + k < n and words[a + k] == words[b + k]:
                    k += 1
                best[a], best[b] = max(best[a], k), max(best[b], k)
        hit = np.zeros(n, bool)
        for a, k in enumerate(best):
            if k >= 5:
                hit[a : a + k] = True
        failed = n < 50 or 100 * windows(words, 3) > 50 * n
        want = not failed and hit.sum() <= 0.2 * n and max(best) <= 100
        assert (got[i].n_covered_words, got[i].longest_repeat, got[i].base_failed, got[i].kept) == (hit.sum(), max(best), failed, want)
        verdicts.add((failed, want))
    assert len(verdicts) == 3


def test_fingerprints_over_block_borders(monkeypatch):
    hashes = [simhash.shingle_hashes(t or "", 3, 42) for t in SOME]
    want = simhash.majority(hashes)
    for block in (1, 7, 100):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert (simhash.majority(hashes) == want).all()


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    for _ in range(300):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(1, 7), replace=False)))
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = {x: x for x in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    for crowd, small in ((20_000, 10_000), (5, 0)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(common, "SMALL", small)
        got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        assert {x: got.get(x, x) for x in fps} == root


def test_token_counts_over_memory_borders(monkeypatch):
    from tonestream.llm import token_counts as tc
    from tonestream.llm import tokens

    texts = [t or "" for t in SOME]
    want = [len(ids(t)) for t in texts]
    for most in (2, 9, 40):
        monkeypatch.setattr(tokens, "MOST", most)
        monkeypatch.setattr(tc, "MOST", most)
        assert tc.Counting(PATH).counts(texts) == want
        chunks = tokens.Chunks(PATH)
        assert [len(chunks.ids(t)) // 4 for t in texts] == want


def test_stretches_over_block_borders(monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in SOME]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["u", "v", "text"])
    rows = lambda: sorted(tuple(r.values()) for b in suffix_dedup.find_stretches(iter([batch]), 200) for r in b.to_pylist())
    want = rows()
    for block in (1, 5000):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert rows() == want


def test_sorted_groups_over_block_borders(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    groups = []
    for h in range(30):
        core = bytes(rng.choices(b"abcd", k=260))
        for c in range(rng.randint(1, 4)):
            data = core[rng.randint(0, 20) :] + bytes(rng.choices(b"xy", k=rng.randint(0, 40)))
            key = int(np.min(suffix_dedup.gram_hashes(np.frombuffer(core[60:200], np.uint8)).view(np.int64)))
            groups.append((key, c, len(data) - 199, data))
    groups.sort(key=lambda g: g[0])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.record_batch([pa.array([g[i] for g in groups], t) for i, t in enumerate(kinds)], names=["h", "c", "r", "data"])
    rows = lambda: sorted(tuple(r.values()) for b in suffix_dedup.sort_groups(iter([batch]), 200) for r in b.to_pylist())
    want = rows()
    for size in (300, 3000):
        monkeypatch.setattr(suffix_dedup, "TEXT", size)
        assert rows() == want


def test_simhash_with_null_and_repeated_ids_and_clashes(spark):
    rows = [(None, "same words here and there"), (7, "same words here and there"), (7, "other text of its own kind"), (None, None), (3, None), (None, "no id at all in this one")]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, fp int, key int, n int, component_id string")
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    by = {t: next(f for i, f, c in got if c == w) for t, w in ((None, 3),)}
    assert by[None] == "0" * 16 and sum(got.values()) == len(rows)
    assert {c for i, f, c in got if f == by[None]} == {3} and {c for i, f, c in got if i == 7} == {7}
    assert [c for i, f, c in got if i is None and f != by[None]].count(None) == 1


def test_operators_with_clashing_columns(spark):
    names = "score int, predicted int, digest int, payload int, last int, n int, words int, url string, html string, page_id long"
    rows = [(1, "a b", 1, 2, 3, 4, 5, 6, 7, "u", "<p>x</p>", 1), (2, None, 1, 2, 3, 4, 5, 6, 7, None, None, None)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    marks = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(df, marks).count() == 2 and sorted(r.doc_id for r in toxicity.kept(df, marks.filter("toxic = 0")).collect()) == [1, 2]
    assert warc.round_trip(df).count() == 2 and html.main_text(df).count() == 2
    assert token_counts.count_tokens(df, PATH).count() == quality.quality(df).count() == 2 and packing.pack(df, PATH).count() >= 2
    assert suffix_dedup.remove_repeats(df).count() == simhash.near_duplicates(df).count() == exact_dedup.exact_dedup(df).count() == 2


def test_toxicity_ties_and_one_class(spark):
    docs_ = spark.createDataFrame([(i, "same text") for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.toxicity(docs_, marks).collect()}) == 1
    assert {r.score for r in toxicity.toxicity(docs_, marks.withColumn("toxic", F.lit(1))).collect()} == {0.0}


def test_warc_with_one_payload_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 0)
    same = "<p>not found</p>" * 100
    rows = [(i, f"u{i}", same if i % 3 else f"own {i} " * 200) for i in range(300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == 300 and sum(r.record_type == "revisit" for r in got) == 199 and {r.refers_to for r in got} == {None, 299}


PAGE = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div><article><h1>Head &amp; all</h1><p>One <b>bo</b>ld<br>two<p>three<div class="comments">me too</div></article><aside>side</aside><form>f</form><footer>end</footer>'


def test_warc(spark):
    same = "é" * 600
    rows = [(1, "http://a/x y", same), (2, "http://a/\n", same), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", same), (2, "again", same)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == same and i != 2
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_ranges(zip64):
    records = [warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None, "d") for i in range(50)]
    raw = warc.package(records, zip64=zip64)
    p = warc.Package(lambda at, n: raw[at : at + n], len(raw))
    assert list(p.records()) == records
    with pytest.raises(ValueError, match="central"):
        warc.Package(lambda at, n: raw[at : at + n], len(raw) // 2)


def test_main_text(spark):
    shared = "Menu one two three four five six seven eight"
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", f"<body><div>{shared}</div><div>only here and nowhere else at all</div>"), (3, "http://h/3", f"<div>{shared}</div><p>another text that is its own and unique"), (4, None, None), (5, "http://h/5", "<article>cut off &am"), (5, "http://h/5", "<article>cut off &am"), (None, None, "<p>no id"), (6, "http://h/6", "<main><h2>Lead</h2><article>body</article></main><div class=comments>mine</div>")]
    df = spark.createDataFrame([(*r, "t", 1, "h", 2) for r in rows], "page_id long, url string, html string, text string, n_chars int, host string, stream int")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html.main_text(df).collect())
    want = [(1, "Head & all One bold two three"), (2, "only here and nowhere else at all"), (3, "another text that is its own and unique"), (4, ""), (5, "cut off &am"), (5, "cut off &am"), (None, "no id"), (6, "Lead body")]
    assert got == collections.Counter((i, t, len(t)) for i, t in want)
    assert html.main_text(df.limit(0)).collect() == []


def plain_main_text(rows):
    """What main_text is to give, string by string: rows of (host, blocks)."""
    streams = collections.defaultdict(set)
    for host, blocks_ in rows:
        streams[host].add(tuple(blocks_))
    out = []
    for host, blocks_ in rows:
        words = lambda bs: [(w, k) for k, t in bs for w in t.split()]
        pages = collections.Counter()
        for s in streams[host]:
            own = [w for w, _ in words(s)]
            pages.update({tuple(own[i : i + html.LONG]) for i in range(len(own) - html.LONG + 1)})
        own, n = words(blocks_), len(streams[host])
        main = "article" if any(k == "article" for _, k in own) else "loose"
        share, least = html.INSIDE if main == "article" else html.LOOSE
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - html.LONG + 1):
            if pages[tuple(w for w, _ in own[i : i + html.LONG])] >= max(share * n, least):
                gone[i : i + html.LONG] = True
        is_main = np.array([k == main for _, k in own], bool)
        if main == "article" and 2 * (gone & is_main).sum() > is_main.sum():
            gone[:] = False
        out.append(" ".join(own[i][0] for i in np.flatnonzero(is_main & ~gone)))
    return out


@pytest.mark.parametrize(("group", "few"), [(html.GROUP, html.FEW), (600, html.FEW), (600, 0)])
def test_host_arrays_equal_brute_force(spark, monkeypatch, group, few):
    monkeypatch.setattr(html, "GROUP", group)
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n))
    notes = [words(rng.randint(8, 30)) for _ in range(6)]
    rows, pages = [], []
    for i in range(120):
        host = ["", "h1", "h2", "big", "big", "big"][i % 6]
        blocks_ = [("chrome", words(4))]
        for _ in range(rng.randint(1, 4)):
            text_ = words(rng.randint(1, 25)) + (" " + rng.choice(notes[: rng.randint(1, 6)]) if rng.random() < 0.7 else "") + (" " + words(3) if rng.random() < 0.5 else "")
            blocks_.append(("article" if i % 4 else "loose", text_))
        if i % 15 == 14:
            host, blocks_ = rows[-6]
        rows.append((host, blocks_))
        tag = {"chrome": "nav", "article": "article", "loose": "div"}
        pages.append((i, f"http://{host}/x" if host else None, "".join(f"<{tag[k]}>{t}</{tag[k]}>" for k, t in blocks_)))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), few=few).collect()}
    want = plain_main_text(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert any(len(w) < sum(len(t) for k, t in r[1] if k != "chrome") for w, r in zip(want, rows, strict=True))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.length <= 1024 for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
