"""Each operator against brute force, on whole small tables and odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, chat, common, components, decontam, linededup, mixing, neardup, pii, queries, sharding, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    line = "a line that many documents share, long enough"
    long_text = "\n".join(f"word{i % 97} tail{i % 89} {line if i % 500 == 0 else i}" for i in range(6000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, long_text), (7, long_text + " x"), (8, line), (9, f" {line.upper()} \nkept"), (10, f"{line}\n{line}"), (11, "é" * 20 + "\x0b"), (12, "\n" + "é" * 20), (13, "É" * 20 + "\né" + "é" * 19)]
    return spark.createDataFrame([(i, t, None, s, None) for (i, t), s in zip(rows, itertools.cycle(["a", None, "b"]))], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def clashing(df):
    """With columns named as those that operators make inside."""
    for c in ("key", "id", "size", "rank", "bucket", "node", "words", "h", "shard", "__id", "drops", "base"):
        df = df.withColumn(c, F.lit("x"))
    return df


# 1


def lines_by_hand(rows, min_docs=3, min_chars=20):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if len(k) >= min_chars:
                holders[k].add(i)
    hot = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if k not in hot or hot[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_line_dedup(request, name):
    df = request.getfixturevalue(name)
    made = linededup.apply(linededup.build(clashing(df)), clashing(df)).collect()
    assert sorted((tuple(r) for r in made), key=repr) == lines_by_hand(rows_of(df))


def test_line_dedup_is_reversible(docs):
    first, second = docs.where("doc_id < 120"), docs.where("doc_id >= 100")
    counts = lambda s: sorted(map(tuple, s.counts.select(F.hex("key"), "n_docs", "max_doc").collect()))
    state = linededup.build(first)
    both = linededup.insert(state, second)
    assert counts(both) == counts(linededup.build(docs))
    assert sorted((tuple(r) for r in linededup.apply(both, docs).collect()), key=repr) == lines_by_hand(rows_of(docs))
    back = linededup.delete(both, docs.where("doc_id >= 120"))
    assert counts(back) == counts(state)
    assert sorted((tuple(r) for r in linededup.apply(back, first).collect()), key=repr) == lines_by_hand(rows_of(first))
    assert linededup.delete(both, docs).counts.count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(2))
    f = linededup.CuckooFilter.of_size(5000)
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(others).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert not linededup.CuckooFilter(4).insert(keys)


def test_line_dedup_decides_by_its_filters(docs, monkeypatch):
    """In many shards and parts the answer is the same; without a filter nothing goes."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 5)
    monkeypatch.setattr(linededup, "hot_keys", lambda counts, key, rows: common.hot_keys(counts, key, 0).withColumn("parts", F.lit(3)) if key == "key" else counts.select(key, F.lit(2).alias("parts")))
    state = linededup.build(docs)
    assert state.shards > 3
    assert sorted((tuple(r) for r in linededup.apply(state, docs).collect()), key=repr) == lines_by_hand(rows_of(docs))
    bare = linededup.State(state.runs, state.count_runs, state.filters.limit(0), state.shards, 3, 20)
    assert linededup.apply(bare, docs).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_dedup_changes_write_only_what_they_touch(docs, monkeypatch):
    monkeypatch.setattr(linededup, "RUNS", 3)
    state = linededup.build(docs.where("doc_id < 150"))
    one = docs.where("doc_id = 160")
    more = linededup.insert(state, one)
    assert len(more.runs) == 2 and more.runs[1].count() == linededup.postings(one).count() and more.count_runs[1].count() <= more.runs[1].count()
    for i in (161, 162, 163):
        more = linededup.insert(more, docs.where(F.col("doc_id") == i))
    assert len(more.runs) <= 3
    whole = linededup.build(docs.where("doc_id < 150 or doc_id between 160 and 163"))
    counts = lambda s: sorted(map(tuple, s.counts.select(F.hex("key"), "n_docs", "max_doc").collect()))
    assert counts(more) == counts(whole)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 5)
    grown = linededup.insert(more, docs)
    assert grown.shards > 2 * more.shards
    assert sorted((tuple(r) for r in linededup.apply(grown, docs).collect()), key=repr) == lines_by_hand(rows_of(docs))


# 2


def test_token_counts(spark, docs, odd, none):
    r = random.Random(3)
    alphabet = "abcé"
    pieces = sorted({tokencount.MARK + "".join(r.choice(alphabet) for _ in range(r.randint(0, 4))) for _ in range(60)} | {"".join(r.choice(alphabet) for _ in range(r.randint(1, 5))) for _ in range(60)})
    for own in (pieces, [p for p in pieces if p != tokencount.MARK], pieces + list(alphabet)):
        automaton, known = tokencount.Automaton(own), set(own)
        for _ in range(3000):
            word = "".join(r.choice(alphabet + "z" * (r.random() < 0.05)) for _ in range(r.randint(1, 12)))
            want = tokencount.greedy_pieces(word, known)
            assert automaton.count(word) == (len(want) if want else 1), word
    for df in (docs, odd, none):
        got = tokencount.count_tokens(clashing(df), pieces).collect()
        want = []
        for i, t in rows_of(df):
            parts = WORDS.findall(t or "")
            want.append((i, len(parts), sum(len(tokencount.greedy_pieces(w, set(pieces)) or [0]) for w in parts)))
        assert sorted((tuple(x) for x in got), key=repr) == sorted(want, key=repr)


# 3


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def classes_by_hand(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            where[x].append(n)
    pairs = {p for v in where.values() for p in itertools.combinations(v, 2)}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return sorted(((i, len(sets[n]), i if i is not None and not sets[n] else least.get(root(n))) for n, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, odd, none, k):
    for df in (docs, odd.where("doc_id is null or doc_id <> 5 or text is not null"), none):
        got = neardup.classes(clashing(df), k, 80).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == classes_by_hand(rows_of(df), k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_in_a_large_group(spark):
    """Copies with more and more edits: chains, isolated ones, several centres."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        own = base[:]
        for _ in range(r.randint(0, 9)):
            own[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(own)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = neardup.classes(df, 4, 80).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == classes_by_hand(rows, 4)


def test_near_duplicates_of_repeated_ids(spark):
    """One doc_id with two texts is two nodes, in any order of rows."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(7, a), (7, b), (8, a + " x"), (9, b + " y"), (None, a), (None, "z z"), (2**62 + 5, "q w e"), (3, None), (10, b + " y"), (10, b + " y")]
    for own in (rows, rows[::-1], sorted(rows, key=repr)):
        made = neardup.classes(spark.createDataFrame(own, "doc_id long, text string"), 4, 80, keyed=True).collect()
        got = sorted(((r["doc_id"], r["component_id"]) for r in made), key=repr)
        assert got == sorted([(7, 7), (7, 7), (8, 7), (9, 7), (None, 7), (None, None), (2**62 + 5, 2**62 + 5), (3, 3), (10, 7), (10, 7)], key=repr)
        assert sorted(((r["doc_id"], r["kept"]) for r in made if r["stays"]), key=repr) == sorted([(7, True), (7, True), (None, None), (2**62 + 5, True), (3, True)], key=repr)


def test_near_duplicates_in_blocks_and_parts(spark, monkeypatch):
    """Many nodes in one bucket, in blocks, with every key hot: nothing is lost.  Long
    texts, where sketches leave most pairs, too."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 10**9)
    r = random.Random(9)
    rows, i = [], 0
    for length in (40, 40, 3000):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(25):
            own = base[:]
            for _ in range(r.randint(0, length // 30)):
                own[r.randrange(length)] = f"e{r.randint(0, 10**6)}"
            rows.append((i := i + 1, " ".join(own)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == classes_by_hand(rows, 4)


def test_components_of_a_long_chain(spark, monkeypatch):
    rounds, real = [], components._to_roots
    monkeypatch.setattr(components, "_to_roots", lambda x: rounds.append(1) or real(x))
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(edges)
    assert got.agg(F.max("component")).first()[0] == 0 and got.count() == 3001 and len(rounds) < 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 102)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)} | {200 + i: 200 for i in range(30)}


# 4


def test_sharding(docs, odd, none):
    for df in (docs, odd, none):
        got = sharding.assign(clashing(df), 16, rows_in_bucket=7).collect()
        want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(df)), key=repr)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rows_of_no_id_are_dealt_to_many_buckets(spark):
    """The slots of many texts under one null doc_id are gapless, whatever their bucket."""
    rows = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("text %d", F.col("id") % 700).alias("text"))
    got = sorted((r["shard"], r["slot"]) for r in sharding.assign(rows, 16, rows_in_bucket=20).collect())
    (shard,) = {s for s, _ in got}
    assert got == [(shard, i) for i in range(900)]


def test_tree_moves_only_what_its_weights_ask_for(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old = sharding.Tree((({0: 1.0, 1: 1.0}, {2: 1.0, 3: 1.0}), ({4: 1.0, 5: 1.0},)))
    new = sharding.Tree((({0: 1.0, 1: 1.0}, {2: 1.0, 3: 0.0}), ({4: 1.0, 5: 1.0},)))
    rows = keys.select(sharding.shard_of(F.col("k"), old).alias("a"), sharding.shard_of(F.col("k"), new).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["a"] in (0, 1, 2, 3) for r in rows)  # only out of the lighter subtrees
    assert not any(r["b"] == 3 for r in rows)
    share = Counter(r["a"] for r in rows)
    assert all(abs(share[s] - 4000 / 6) < 120 for s in range(6))


# 5


def test_chat(spark, sf_dir):
    hard = [(1, 0, "user", "</s>[INST] \\[ <\\ \\\\ <|text|>"), (1, 1, "assistant", None), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (None, 2, None, "x"), (2, None, "us<er", "\\"), (2, 3, "assistant", "é🙂<"), (2, 4, "user", "tail")]
    extra = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").unionByName(extra.withColumn("conv_id", F.col("conv_id") + 10**6))
    parts = chat.segments(table.withColumn("seq", F.lit("x")))
    got = {r["conv_id"]: r for r in chat.digests(parts).collect()}
    convs = defaultdict(list)
    for r in table.collect():
        convs[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or "", r["text"] is not None, r["text"] or ""))
    assert set(got) == set(convs)
    examples = defaultdict(list)
    for r in chat.materialize(parts).collect():
        examples[r["conv_id"]].append(r)
    for conv, turns in convs.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        replies = [t for role, t in turns if role == "assistant"]
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len("".join(replies)), hashlib.sha256("".join(replies).encode()).hexdigest())
        own = sorted(examples[conv], key=lambda x: x["example"])
        assert [chat.unescape(x["text"][x["loss_start"] : x["loss_start"] + x["loss_length"]]) for x in own] == replies
        ends = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        for x, end in zip(own, ends, strict=True):
            assert x["text"] == "".join(chat.format_turn(*t)[0] for t in turns[: end + 1])


def test_each_example_is_read_from_its_own_text(spark, monkeypatch):
    """Context, reply and length of every example, over several groups; a mask that
    points elsewhere changes the digest."""
    monkeypatch.setattr(chat, "GROUP", 3)
    rows = [(1, i, "assistant" if i % 2 or i > 15 else "user", f"text <{i}>") for i in range(20)] + [(2, 0, "user", "only")]
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(map(tuple, chat.expand(parts).collect()))
    ends = [i for i, (c, _, role, _) in enumerate(rows) if c == 1 and role == "assistant"]
    want = []
    for n, end in enumerate(ends):
        own = rows[: end + 1]
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        want.append((1, n, len(own), hashlib.sha256(turns.encode()).hexdigest(), sum(len(chat.format_turn(r, t)[0]) for _, _, r, t in own), rows[end][3]))
    assert got == want
    right, wrong = (chat.digests(x).where("conv_id = 1").first() for x in (parts, parts.withColumn("loss_start", F.col("loss_start") + 1)))
    assert right["loss_sha256"] == hashlib.sha256("".join(rows[e][3] for e in ends).encode()).hexdigest() != wrong["loss_sha256"]


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.segments(none)).count() == chat.expand(chat.segments(none)).count() == 0


def test_escape_round_trip():
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice("<[\\|s/>ab") for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"</?s>|\[/?INST\]|<\|text\|>", chat.escape(text))


# 6


def leaks_by_hand(docs, items, percent=80):
    words = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", (x or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)]
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            q = words(u)
            if not q or not w:
                continue
            k, want, best = min(5, len(q)), Counter(grams(q)), None
            if not set(want) & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                continue
            for s in range(max(0, len(w) - len(q)) + 1):
                own = w[s : s + len(q)]
                have = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
                shared = sum((have & want).values())
                total = sum(have.values()) + sum(want.values()) - shared
                if 100 * shared >= percent * total and (best is None or shared / total > best[0]):
                    best = (shared / total, s)
            if best:
                out[d, i] = best
    return out


def test_decontamination(spark, docs, odd, none, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    text = bench.orderBy("item_id").first()["text"]
    w = text.split()
    planted = [(9001, "x y z " + text + " tail"), (9002, text.upper()), (9003, " ".join(w[:-1]) + " other"), (9004, " ".join(w[: len(w) // 2])), (9005, " ".join(w[2:]) + " a b c d"), (9006, "one two three"), (9007, "q one two three q")]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in planted], DOCS)
    items = bench.unionByName(spark.createDataFrame([(7001, "One two three"), (7002, None), (7003, ""), (7001, "One two three")], "item_id long, text string"))
    all_docs = docs.unionByName(extra).unionByName(odd)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontam.find(clashing(all_docs), items).collect()}
    want = leaks_by_hand(sorted(set(rows_of(all_docs)), key=repr), [(r["item_id"], r["text"]) for r in items.distinct().collect()])
    assert got == want and {(9001, bench.orderBy("item_id").first()["item_id"]), (9007, 7001)} <= set(got)
    assert decontam.find(none, items).count() == 0 and decontam.find(docs, items.limit(0)).count() == 0


def test_decontamination_of_null_ids(spark):
    item = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(None, "a " + item), (None, "b c " + item + " " + other), (None, "clean text"), (0, "d e f " + other), (1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, other), (3, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in decontam.find(docs, items).collect()), key=repr)
    assert got == sorted([(None, None, 1, 1.0), (None, 3, 1, 1.0), (None, None, 2, 1.0), (None, 3, 2, 1.0), (None, None, 32, 1.0), (0, None, 3, 1.0)], key=repr)


def test_long_items_are_compared_whole(spark):
    """Beyond 2**15 shingles, and far beyond a counter's 16 bits; a share of an item
    is not the item."""
    words = [f"w{i}" for i in range(70_000)]
    rows = [(1, "a b " + " ".join(words) + " c"), (2, " ".join(words[:30_000])), (3, " ".join(words[6_000:])), (4, "w1 w2 w3 w4 w5 w6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert set(got) == {1, 3} and (got[1]["start_word"], got[1]["similarity"], got[1]["window_words"]) == (2, 1.0, 70_000)
    assert got[3]["shared"] == 64_000 - 4 and got[3]["total"] == 70_000 - 4


def test_candidates_come_from_fingerprints(spark, docs, sf_dir, monkeypatch):
    """Without the Hamming radius nothing is found, and the filter names no item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    full = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, bench).collect()}
    assert full
    monkeypatch.setattr(decontam, "RADIUS", -1)
    monkeypatch.setattr(decontam, "_blocks", lambda: [(0, 3), (3, 3)])
    assert decontam.find(docs, bench).count() == 0
    hits = decontam._hits(docs, decontam.anchors_of(decontam.items_of(bench)), decontam.items_of(bench).select("m", F.explode("grams").alias("gram")))
    assert not {"item", "item_id"} & set(hits.columns)


def test_windows_meet_few_items(spark, monkeypatch):
    """Items of one length: a window is compared with those that chose a word of its
    run, not with all, and every near copy is found."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 11))) for _ in range(1500)]
    texts = [[r.choice(vocabulary) for _ in range(30)] for _ in range(150)]
    docs = []
    for i in range(120):
        own = list(texts[i])
        own[(3 * i) % 2 * 29] = "other"
        docs.append((i, " ".join(r.choices(vocabulary, k=40) + own + r.choices(vocabulary, k=40) + texts[-1 - i % 20][:9])))
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    saved = {}
    monkeypatch.setattr(decontam, "save", lambda df, name, **k: saved.setdefault(name, common.save(df, name, **k)))
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == set(leaks_by_hand(docs, items)) and {(i, i) for i in range(120)} <= got
    windows = saved["leak-windows"].count()
    pairs = saved["leak-windows"].join(saved["leak-met"], [*decontam._RUN, "run"]).count()
    print(f"{windows} windows, {len(items)} items, {pairs / windows:.1f} items a window")
    assert 0 < pairs <= 0.05 * windows * len(items)


def test_repeated_words_in_items_and_windows(spark):
    """Weights above one, windows that overlap themselves."""
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abc") for _ in range(n))) for i, n in enumerate((6, 7, 9, 12, 5, 3, 1))]
    texts = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 60)))) for i in range(40)] + [(90 + i, "x " + t + " y " + t) for i, t in items]
    got = decontam.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (x["similarity"], x["start_word"]) for x in got} == leaks_by_hand(texts, items)


# 7

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def spans_by_hand(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii(spark, docs, odd, none):
    r = random.Random(6)
    made = ["a@b.c_x@d.e.f +1 (743) 555-3824 a 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111", "é🙂x@y.zz, 0001.2.3.4 @@a@b.c", "1" * 3000 + " " + "9 " * 2000, "1.2.3.0004 300.2.2.2 4111-1111-1111-1111", "+1 234 5678 90- +49 (0) 30 1234567"]
    made += ["".join(r.choice("0123456789 .-+@ab()") for _ in range(80)) for _ in range(300)]
    extra = spark.createDataFrame([(5000 + i, t, None, None, None) for i, t in enumerate(made)], DOCS)
    for df in (docs.unionByName(extra), odd, none):
        found = pii.digest(pii.find(clashing(df))).collect()
        texts = sorted(rows_of(df), key=repr)
        for row, (i, t) in zip(sorted(found, key=lambda x: repr((x["doc_id"],))), sorted(texts, key=lambda x: repr((x[0],))), strict=True):
            assert row["doc_id"] == i
        by_hash = Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in spans_by_hand(t or "")).encode()).hexdigest()) for i, t in texts)
        assert Counter((x["doc_id"], x["base_sha256"]) for x in found) == by_hash


def test_pii_model_adds_and_redacts(spark):
    rows = spark.createDataFrame([(1, "call (212) 555-1234 or secret: abcd1234efgh5678ijkl9012 by a@b.cd on 2024-01-02")], "doc_id long, text string")
    found = pii.find(rows)
    spans = pii.digest(found).first()["spans"]
    assert spans.startswith("number:5:19,secret:31:55,email:59:65") and "2024" not in pii.redact(found).first()["text"].replace("2024-01-02", "")
    assert pii.redact(found).first()["text"] == "call [number] or secret: [secret] by [email] on 2024-01-02"


def test_pii_generators_are_calibrated(spark):
    """On texts that neither trees nor thresholds have seen: every generator adds
    spans, most of them right; none is shut off, look-alikes stay out."""
    trees, thresholds, report = pii._model(spark.sparkContext.applicationId)
    assert all(0 <= t < 20 for t in thresholds)
    assert all(precision > 0.88 and recall > 0.5 and n > 100 for precision, recall, n in report.values()), report
    texts = ["follow @jane_doe84 today", "@Override\npublic", "commit " + "a1b2c3d4" * 5, "token = \"" + "a1b2c3d4" * 5 + "\"", "Telefon: 030 1234 5678 danke", "isbn 978-3-16-148410-0 page", "pages 1990-1995 of", "Konto 123456789 bitte"]
    rows = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    kinds = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",") if x] for r in rows}
    assert kinds[0] == ["handle"] and kinds[1] == [] and kinds[2] == [] and kinds[3] == ["secret"] and kinds[4] == ["number"] and kinds[6] == [] and kinds[7] == ["digits"]
    assert all(r["n_extra"] == len(kinds[r["doc_id"]]) - sum(r[f"n_{k}"] for k in pii.KINDS) and r["n_spans"] == len(kinds[r["doc_id"]]) for r in rows)
    # The trees decide: without them no span is added.
    assert sum(len(k) for k in kinds.values()) > 0 and len(trees) > 10


def test_pii_overlaps_by_hand(spark):
    """Added spans overlap neither base spans nor each other."""
    r = random.Random(12)
    piece = lambda: r.choice(["tel: 030 1234 5678", "call 555-123-4567", "token=" + "ab12" * 8, "@joe_91", "a@b.cd", "1.2.3.4", "4111 1111 1111 1111", "+1 234 5678 90", "account 123456789", "x", "2024-01-02"])
    rows = [(i, r.choice(["", " "]).join(piece() + " " for _ in range(r.randint(1, 40)))) for i in range(60)]
    added = 0
    for x in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (y.split(":") for y in x["spans"].split(",") if y)]
        extra = [s for s in spans if s[0] in pii.EXTRA]
        added += len(extra)
        assert len(extra) == x["n_extra"]
        for i, (k, a, b) in enumerate(extra):
            assert a < b and not any(a < d and c < b for _, c, d in [s for s in spans if s[0] in pii.KINDS] + extra[:i])
    assert added > 100


def test_pii_of_a_text_with_very_many_spans(spark):
    text = " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(64_000))
    began = time.time()
    row = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row["n_spans"] > 60_000 and time.time() - began < 60


# 8


def test_ann(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    zero = [0.0] * 64
    bad = spark.createDataFrame([(10**6, None), (10**6 + 50, zero), (10**6 + 100, [float("nan")] * 64), (10**6 + 150, [1.0, None])], "vec_id long, embedding array<float>")
    copies = table.where("vec_id = 0").select(F.explode(F.sequence(F.lit(2 * 10**6), F.lit(2 * 10**6 + 49))).alias("vec_id"), "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    whole = table.unionByName(bad).unionByName(copies)
    got = defaultdict(list)
    for r in ann.nearest(whole).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.unionByName(copies).collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    norms = np.sqrt((x * x).sum(1))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i] / (norms * norms[i])
        score[i] = -2
        best = np.lexsort((ids, -np.round(score, 12)))[:5]
        hit += len({a for a, _ in got[ids[i]]} & set(ids[best].tolist()))
        total += 5
        assert all(math.isclose(s, score[ids == a][0], rel_tol=1e-12, abs_tol=1e-15) for a, s in got[ids[i]])
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hit / total >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0


def test_ann_in_shards(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 120)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = defaultdict(set)
    for r in ann.nearest(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = [len(got[q] & set(sorted((o for o in x if o != q), key=lambda o: (-float(x[q] @ x[o]) / np.linalg.norm(x[o]), o))[:5])) for q in x if q % 50 == 0]
    assert sum(hit) >= 0.9 * 5 * len(hit)


# 9


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[x["doc_id"]]["predicted"], x["toxic"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert not any(a and not b for a, b in held)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(other, toxicity.train(other, labels)).collect()} == {i: r["score"] for i, r in rows.items()}
    model = toxicity.train(odd, labels.limit(0))
    assert toxicity.score(clashing(odd), model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "you stupid idiot")], "doc_id long, text string"), model).first()["predicted"] == 1


def test_label_model_finds_accuracies_and_copies():
    """Without any label: rates, the copy of a voter, and posteriors near the truth."""
    rng = np.random.default_rng(4)
    y = rng.random(6000) < 0.2
    rates = np.array([[0.01, 0.02, 0.01, 0.02, 0.6], [0.7, 0.6, 0.5, 0.5, 0.1]])
    votes = (rng.random((6000, 5)) < np.where(y[:, None], rates[1], rates[0])).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # a voter that copies the first
    clean = np.array([False, False, False, False, True, False])
    post, fitted, parents = toxicity.fit_label_model(votes, y.mean(), clean)
    assert np.mean((post > 0.5) == y) > 0.94  # 2 % of the rows have no vote
    assert parents[5] == 0 or parents[0] == 5
    assert (fitted[1, [0, 1, 2, 3]] > 8 * fitted[0, [0, 1, 2, 3]]).all() and fitted[0, 4] > 3 * fitted[1, 4]
    # The copy is no evidence of its own: one vote stays one vote.
    alone, _, _ = toxicity.fit_label_model(votes[:, :5], y.mean(), clean[:5])
    only = (votes.sum(1) == 2) & (votes[:, 0] == 1)
    assert only.any() and np.abs(post[only] - alone[only]).max() < 0.1


def test_label_model_decides_the_training_labels(spark):
    """The classifier learns posteriors, not the given labels: they differ, agree for
    the most part, and another model of the votes gives another classifier."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.fitting_rows(docs, labels)
    voters, clean = toxicity.mine_voters(sample)
    counts, known = toxicity.votes_of(sample, voters)
    votes, side = (counts > 0).astype(float), np.array([v in clean for v in voters])
    post, _, _ = toxicity.fit_label_model(votes, known.mean(), side)
    assert 0.9 < np.mean((post > 0.5) == known) < 1 and 0.005 < np.abs(post - known).mean() < 0.2
    assert side.sum() >= 3 and (~side).sum() > 15 and {"x:you insult", "x:plain"} <= set(voters)
    turned, _, _ = toxicity.fit_label_model(votes, known.mean(), ~side)
    assert np.mean((turned > 0.5) == (post > 0.5)) < 0.9


def test_scores_are_those_of_the_model(spark, odd):
    """By hand: the counts of each voter, their logarithms, the weights."""
    voters = [toxicity.INSULT, "w:idiot", "p:idio", "2p:idio", "x:two insults", toxicity.PLAIN]
    model = toxicity.Model(voters, np.array([1.0, 0.5, 0.25, 2.0, 3.0, -1.0]), -1.5)
    texts = ["You idiot, idiotic idiot!", None, "", "fine words", " ".join(["plain"] * 30), "IDIOT"]
    wanted = [[2, 2, 1, 0, 1, 0], [0] * 6, [0] * 6, [0] * 6, [0, 0, 0, 0, 0, 1], [1, 1, 1, 0, 0, 0]]
    # p:idio counts words that begin so and are longer: all three.
    wanted[0][2:4] = [3, 2]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        z = float(np.log1p(wanted[r["doc_id"]]) @ model.weights) - 1.5
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r["predicted"] == (z >= 0)


def test_toxicity_with_clashing_columns_and_repeated_ids(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 14)] + [(4, 1, "y")], "doc_id long, toxic int, text string")
    docs = clashing(odd).withColumn("toxic", F.lit("x")).withColumn("predicted", F.lit(1))
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == odd.count()
    many = odd.where("doc_id = 5").crossJoin(spark.range(50)).drop("id")
    assert toxicity.fitting_rows(many, labels.where("doc_id = 5")).count() <= 1


# 10


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, done, target = sum(sizes.values()), {}, {}
    while True:
        left = total - sum(done.values())
        live = [s for s in order if s not in done]
        target = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = [s for s in live if target[s] > most * sizes[s]]
        if not over:
            return done | target
        done |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("block", [16, 1024])
def test_mixing(docs, odd, none, block):
    for df in (docs, odd, docs.where("doc_id % 9 = 0").withColumn("source", F.when(F.col("doc_id") % 27 == 0, F.lit("a")).otherwise(F.col("source"))), none):
        made = mixing.mix(clashing(df), block=block, rows_in_bucket=11)
        got = made.docs.collect()
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
        assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, len(WORDS.findall(t or ""))) for i, t in rows_of(df)), key=repr)
        want, taken = targets_by_hand(dict(sizes)) if sizes else {}, defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        again = mixing.mix(df.orderBy(F.desc("doc_id")), block=block, rows_in_bucket=11).docs.collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
        slots = made.slots.collect()
        assert sum(s["words"] for s in slots) == sum(taken.values())
        assert len({(s["shard"], s["position"]) for s in slots}) == len(slots)


def test_mixed_shards_hold_the_words(docs, odd):
    """Every slot has the words of its block, and the words taken are those."""
    for df in (docs, odd):
        made = mixing.mix(clashing(df), block=64, rows_in_bucket=11)
        source = defaultdict(Counter)
        for r in df.collect():
            source[r["source"]].update(WORDS.findall(r["text"] or ""))
        blocks = {(r["source"], r["block"]): [w for p in r["pieces"] for w in p["text"].split(" ")] for r in made.blocks.collect()}
        packed = defaultdict(Counter)
        for (s, _), own in blocks.items():
            packed[s].update(own)
        assert all(packed[s] == source[s] for s in source)
        last = {s: max(b for x, b in blocks if x == s) for s in {x for x, _ in blocks}}
        assert all(len(own) == 64 for (s, b), own in blocks.items() if b != last[s])
        slots = {(r["shard"], r["position"]): r for r in made.slots.collect()}
        mixed, taken = made.mixed.collect(), Counter()
        assert len(mixed) == len(slots)
        for r in mixed:
            slot = slots[r["shard"], r["position"]]
            own = [w for p in r["pieces"] for w in p["text"].split(" ")]
            assert (r["source"], r["block"]) == (slot["source"], slot["block"]) and own == blocks[r["source"], r["block"]][: slot["words"]]
            for p in r["pieces"]:
                taken[r["source"], p["doc_id"]] += len(p["text"].split(" "))
        given = Counter()
        for r in made.docs.collect():
            given[r["source"], r["doc_id"]] += r["taken"]
        assert +given == taken


def test_slots_are_dealt_by_seed(docs):
    """A shard's sources are a draw: not the same as with another seed, and not the
    even split that dealing in turn gives."""
    by = []
    for seed in (7, 8):
        slots = mixing.mix(docs, block=16, seed=seed).slots.collect()
        share = Counter(r["source"] for r in slots)
        cells = Counter((r["shard"], r["source"]) for r in slots)
        chi = sum((cells[k, s] - share[s] / 16) ** 2 / (share[s] / 16) for s in share for k in range(16))
        free = 15 * (len(share) - 1)
        assert abs(chi - free) < 5 * math.sqrt(2 * free)
        sizes = Counter(r["shard"] for r in slots)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        by.append(cells)
    assert by[0] != by[1]


# queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, duck, name):
    made = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    wanted = duck.sql(queries.ORACLES[name])
    assert sorted(wanted.columns) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in made.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        made = stage(spark, docs, sf_dir)
        if name != "sharding":
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name == "near_duplicates":
            rows = rows_of(before)
            want = {i for (i, _, c) in classes_by_hand(rows, 5) if i == c}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
            leaks = {d for d, _ in leaks_by_hand(rows_of(before), [(r["item_id"], r["text"]) for r in bench])}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - leaks
    assert Counter(r["doc_id"] for r in kept["sharding"].collect()) == Counter(r["doc_id"] for r in kept["mixing"].collect())
    empty = kept["toxicity"].limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_removes_what_its_stages_saved(spark, sf_dir):
    """A run leaves its stages' results, and tables saved outside it stay."""
    import corpus_pipeline as P

    mine = common.save(spark.range(3), "mine")
    folder = f"{common.shared_dir(spark)}/gleaner"
    before = set(os.listdir(folder))
    got = P.run(spark, sf_dir)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-") and before <= set(os.listdir(folder))
    assert got.count() > 0 and mine.count() == 3


def test_pipeline_on_odd_rows(spark, sf_dir, odd):
    """Null ids and texts, empty and long texts and repeated rows go through every
    stage; what isn't toxic, copied or leaked stays."""
    import corpus_pipeline as P

    columns = odd.columns
    toxic, single, clean, mixed, shards = (f for _, f in P.STAGES)
    a = toxic(spark, odd, sf_dir)
    assert a.columns == columns and a.count() == odd.count()
    b = single(spark, a, sf_dir)
    left = Counter(rows_of(b))
    assert b.columns == columns and left[1, None] == left[2, ""] == left[3, "  \n\t"] == 1 and left[4, "one"] == 1 and not left[5, "one"]
    assert left[None, None] == 1 and left[8, rows_of(odd.where("doc_id = 8"))[0][1]] == 1 and not left[None, "one"]
    c = clean(spark, b, sf_dir)
    assert Counter(rows_of(c)) == left
    d = mixed(spark, c, sf_dir)
    assert d.columns == columns and set(rows_of(d)) <= set(left) and Counter(rows_of(d))[1, None] == 1
    assert shards(spark, d, sf_dir).count() == d.count()


def test_pipeline_decides_on_null_ids_by_row(spark, sf_dir):
    """A toxic, copied or leaked row without an id takes no other such row with it."""
    import corpus_pipeline as P

    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    near = " ".join(f"near{i}" for i in range(60))
    rows = [(None, "you stupid idiot"), (None, near), (None, near + " tail"), (None, "clean words of its own"), (None, None), (None, "x " + leak), (4, "one"), (None, "one")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    clean = {(None, "clean words of its own"), (None, None), (4, "one")}
    toxic, single, decontaminate = (f for _, f in P.STAGES[:3])
    a = rows_of(toxic(spark, docs, sf_dir))
    assert clean | {(None, near)} <= set(a) and (None, "you stupid idiot") not in a
    b = rows_of(single(spark, docs, sf_dir))
    assert clean <= set(b) and (None, "one") not in b and len({(None, near), (None, near + " tail")} & set(b)) == 1
    c = rows_of(decontaminate(spark, docs, sf_dir))
    assert sorted(c, key=repr) == sorted(set(rows) - {(None, "x " + leak)}, key=repr)


def test_pipeline_keeps_every_innocent_row_of_an_id(spark, sf_dir):
    """Rows of one doc_id, or of none, with different texts: one that goes takes no
    other along, in any order of rows; copies are drawn row by row."""
    import corpus_pipeline as P

    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    near = " ".join(f"near{i}" for i in range(60))
    innocent = [(None, "unique clean words of one"), (None, "and of another"), (7, "x y z w"), (7, "some more text"), (8, "of eight"), (None, None), (7, None), (7, "")]
    rows = [*innocent, (4, "one two"), (7, "one two"), (None, "one two"), (7, "you stupid idiot, you moron"), (None, "you stupid idiot, worthless scum"), (8, "x " + leak), (None, leak + " y"), (8, near), (8, near + " tail"), (None, near)]
    toxic, single, decontaminate, mixed = (f for _, f in P.STAGES[:4])
    for own in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, None, "ab"[n % 2], None) for n, (i, t) in enumerate(own)], DOCS)
        a = rows_of(toxic(spark, docs, sf_dir))
        assert sorted(a, key=repr) == sorted((r for r in rows if "stupid" not in (r[1] or "")), key=repr)
        b = rows_of(single(spark, docs, sf_dir))
        assert set(innocent) <= set(b) and (4, "one two") in b and not {(7, "one two"), (None, "one two"), (None, near)} & set(b)
        assert len({(8, near), (8, near + " tail")} & set(b)) == 1
        c = rows_of(decontaminate(spark, docs, sf_dir))
        assert sorted(c, key=repr) == sorted((r for r in rows if leak not in (r[1] or "")), key=repr)
        d = mixed(spark, clashing(docs), sf_dir)
        assert d.columns == clashing(docs).columns
        copies, sizes = Counter(rows_of(d)), {r: len(WORDS.findall(r[1] or "")) for r in rows}
        taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs).docs.collect()}
        assert all(copies[r] == 1 if not n else copies[r] in (taken[r[0], n] // n, -(-taken[r[0], n] // n)) for r, n in sizes.items() if [(x[0], sizes[x]) for x in rows].count((r[0], n)) == 1)


def test_ann_takes_one_row_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (50, [-1.0, 0.0]), (4, [1.0, 0.0, 0.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 3), (2, 1), (3, 2), (4, 50)]
    assert got[0][3] == 1.0


def test_ann_of_extreme_vectors_and_ties(spark, monkeypatch):
    """Very large and small vectors, and more scaled copies than a beam holds: ties go
    to the smallest ids."""
    r = random.Random(4)
    rows = [(0, [1.0, 0.0, 0.0]), (50, [1e200, 0.0, 0.0]), (7, [1e-200, 0.0, 0.0]), (100, [0.0, 1e300, 1e300]), (101, [0.0, 1e-300, 1e-300])]
    rows += [(1000 - i, [2.0 ** (i % 60 - 30) * (1 + i // 60), 0.0, 0.0]) for i in range(300)] + [(2000 + i, [r.random() for _ in range(3)]) for i in range(300)]
    got = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("shard", F.lit(1))
    for x in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    assert [i for i, _ in got[0]] == [7, 50, 701, 702, 703] and all(math.isclose(s, 1.0, rel_tol=1e-15) for _, s in got[0])
    assert [i for i, _ in got[50]][:2] == [0, 7] and got[100][0] == (101, got[100][0][1]) and math.isclose(got[100][0][1], 1.0)
