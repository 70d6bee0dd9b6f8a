"""Resampling, the prefix trie and the n-gram join against brute force on small tables with nulls, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webloom.llm import ngramjoin, op12, resample, trie

from test_llm import TEXTS, prose, edited, shingle_set

BASE = prose(31, 90)
MORE = TEXTS + [(20 + i, edited(BASE, list(range(i, 90, 29)))) for i in range(14)] + [(50 + i, "same line of five words\n" + prose(60 + i, 25 + i)) for i in range(10)]
CLASH = "doc_id bigint, text string, row int, t string, n int, k int, h int, c int, rank int, times int, node string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5, 6, 7, "y") for i, t in [*MORE, (None, "no id here at all")]], CLASH).repartition(5)


def linked(num, den, k):
    sets = {}
    for i, t in MORE:
        sets[i] = shingle_set(t, k)
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("num,k,longest,block", [(85, 4, 16, 256), (80, 5, 16, 2), (60, 4, 1, 3)])
def test_ngram_join(docs, monkeypatch, num, k, longest, block):
    monkeypatch.setattr(ngramjoin, "LONGEST", longest)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    got = ngramjoin.ngram_join(docs, size=k, num=num).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(num, 100, k)
    assert len(got) == len(MORE)


def test_ngram_join_without_stars(docs, monkeypatch):
    """All links from the full count of shared prefix hashes, in blocks of two documents."""
    monkeypatch.setattr(ngramjoin, "TURNS", 0)
    monkeypatch.setattr(ngramjoin, "BLOCK", 2)
    got = ngramjoin.ngram_join(docs, size=4, num=70).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(70, 100, 4)


def test_ngram_join_of_one_id_with_two_texts(spark):
    rows = [(1, BASE), (1, "quite another text of some words"), (2, BASE), (3, "quite another text of some words")]
    got = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id int, text string"), size=4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_classes"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_share_what_they_ask_for():
    """Any two sets over the threshold share min(k, l) hashes of their prefixes, whatever the table says."""
    rng = np.random.default_rng(5)
    table = rng.integers(0, 200, ngramjoin.SLOTS).astype(np.int32)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (k, x), (other, y) = (ngramjoin.prefix(s, table, 20.0, 80, 100) for s in (a, b))
        assert len(np.intersect1d(x, y)) >= min(k, other)
        assert np.bitwise_count((ngramjoin.marks(a) ^ ngramjoin.marks(b)).view(np.uint64)).sum() <= len(a) + len(b) - 2 * both


def floor_mean(values):
    return sum(values) // len(values) if values else 0


def drawn(docs, goal, percent=25, seed=7, least=20):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def features(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(low))
        return w, w + [x + b" " + y for x, y in zip(w, w[1:])]

    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, goal)):
        for text in texts:
            counts.update(zlib.crc32(f) % 10000 for f in features(text)[1])
    size, wanted = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * size / ((s[b] + 1) * wanted))) for b in s}
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = floor_mean([gain[zlib.crc32(x) % 10000] for x in f])
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if i is not None else None, len(w)])
    able = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able) if k < percent * len(able) // 100}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("percent", [25, 80])
def test_resample(spark, docs, percent, monkeypatch):
    monkeypatch.setattr(resample, "HOT", 16)
    goal = [BASE, None, "", "moon\nsun  star\r\nSEA", prose(2, 50)]
    extra = [(201, "A\n\nb\nA\n\nB c\n" * 9), (202, "\n \n"), (203, "Ünï cödé 日本 x" * 6), (204, "w" * 100_000 + "\n" + "w" * 100_000)]
    rows = [*MORE, (None, "no id here at all"), *extra]
    table = docs.select("doc_id", "text", "row", "rank").unionByName(spark.createDataFrame([(*r, 0, 0) for r in extra], "doc_id long, text string, row int, rank int"))
    target = spark.createDataFrame([(i, t) for i, t in enumerate(goal)], "row int, text string")
    got = resample.resample(table, target, percent=percent).collect()
    assert Counter(tuple(r) for r in got) == drawn(rows, goal, percent)


def test_resample_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert [tuple(r)[:2] for r in resample.resample(some, none).collect()] == [(1, 53)]


def nodes_of(convs):
    """{(depth, conv_id): …} of conversations given as {id: [(role, text), …]}."""
    members = defaultdict(list)
    for i, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(i)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(i) for i in sorted(ids) if len(convs[i]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(table):
    own = defaultdict(list)
    for i, turn, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own[i].append((role or "", text or ""))
    out = {}
    for i, turns in own.items():
        h = zlib.crc32(str(i).encode()) % 4
        out[i] = own.get(i - i % 20, [])[:h] + turns[h:]
    return out


def conversations():
    rng = np.random.default_rng(8)
    words = ["yes", "no", "one two", "", None, "tell  me\tmore\n"]
    rows = []
    for i in [*range(0, 60), 100, 101, 105, 119]:
        if i in (100, 20):
            continue
        for turn in range(int(rng.integers(1, 7))):
            rows.append((i, turn if turn else None, ["user", "assistant", None][turn % 3], words[int(rng.integers(0, len(words)))]))
    rows += [(200 + i, t, "user", f"turn {t}") for i in range(30) for t in range(4)]  # a large group of equal ones
    rows += [(7, 1, "assistant", "no"), (7, 1, "assistant", "no"), (None, 0, "user", "nobody's"), (300, 0, "u", "a"), (300, 1, "u", "b" * 50_000)]
    return rows


@pytest.mark.parametrize("block,turns,ids", [(1 << 15, 1 << 18, 4096), (3, 1 << 18, 2), (1 << 15, 5, 7)])
def test_prefix_trie(spark, monkeypatch, block, turns, ids):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "TURNS", turns)
    monkeypatch.setattr(trie, "IDS", ids)
    table = [r for r in conversations() if r[:2] != (7, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in table], "conv_id bigint, turn int, role string, text string, node string, depth int, low int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = trie.build(op12.rebuilt(trie.sequences(df)))
    nodes = got.nodes.join(trie.digest_of_ends(got.ends), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or nothing) for r in nodes.collect()]
    assert sorted(rows, key=repr) == nodes_of(rebuilt(table))


def test_prefix_trie_of_repeated_turns(spark):
    df = spark.createDataFrame(conversations(), "conv_id bigint, turn int, role string, text string")
    lengths = {r["conv_id"]: len(r["turns"]) for r in trie.sequences(df).collect()}
    assert lengths == {i: len(t) for i, t in rebuilt_lengths(conversations()).items()}


def rebuilt_lengths(rows):
    out = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            out[r[0]].append(r)
    return out


def test_prefix_trie_of_nothing(spark):
    got = trie.build(op12.rebuilt(trie.sequences(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))
    assert got.nodes.collect() == [] and trie.digest_of_ends(got.ends).collect() == []


def test_words_encoded_by_pieces_equal_whole_texts():
    """Runs that mix plain words, signs, other scripts, combining marks, special tokens and broken UTF-8."""
    import random

    from webloom.llm import tokens
    from webloom.llm.op2 import word_tokenizer

    parts = ["a", "B", "é", "É", "ß", "1", "2", ".", "'", "é", " ", " ", "  ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "日本", "<|", "ﬁ", "🙂", "don't", "​", ""]
    draw = random.Random(1)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))).encode() for _ in range(1500)]
    texts += [b"", b"  ", b"\xff\xfe a", b"\xcc"]
    encoder = tokens.Encoder(word_tokenizer(), True)
    for _ in range(2):  # the second time all words are known
        ids, n = encoder(texts)
        whole = encoder._raw(texts)
        assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
