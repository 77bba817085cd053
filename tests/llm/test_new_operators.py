"""Packing by concatenation, Merkle manifest and prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textscore.llm import ann, concat_cut, encoding, langid, merkle, packing, prefix_trie, quality
from textscore.llm.queries import QUERIES, read, tokenizer_path

SF = "/root/testdata/sf0.001"
TOKENIZER = tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " \n\t ", "x", "Plain words, in a row.", "Plain words, in a row.", "<|endoftext|> a<|startoftext|>b", "½ ² é日本 🙂 it's don't 'Re",
    "a\x1cb\x85c d", "İßǅ ẞ ́x é", "''''''''" * 40, "word " * 9000, "q" * 5000,
]


# ---------------------------------------------------------------- packing
def library_ids():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, length):
    ids, end = library_ids(), [1]
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(ids(text) + end)
    sequences, got = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        got[r.doc_id].append(r)
    for doc, lists in want.items():
        assert all(r.doc_tokens in {len(x) for x in lists} for r in got[doc])
        assert sum(r.length for r in got[doc]) == sum(map(len, lists))
        if len(lists) == 1:  # pieces of a repeated id cannot be told apart
            at = 0
            for r in sorted(got[doc], key=lambda r: r.start):
                assert r.start == at
                at += r.length
        known = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for r in got[doc] for x in lists}
        assert all(r.ids_crc32 in known for r in got[doc])
    assert set(got) == set(want)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length and (at == length or at & (at - 1) == 0)  # nothing is padded


def test_packing_equals_the_library(spark):
    docs = read(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(QUERIES["op11_concatenate_and_cut"](spark, SF).collect(), texts, 2048)


@pytest.mark.parametrize("length, chunk, parts", [(16, 7, 5), (2048, 1 << 18, 3), (5, 1 << 18, 1), (1, 3, 2)])
def test_packing_of_edge_rows(spark, monkeypatch, length, chunk, parts):
    monkeypatch.setattr(concat_cut, "CHUNK", chunk)
    texts = [*enumerate(ODD if length > 1 else ODD[:9]), (None, "no id"), (3, "x"), (3, "another text of a known id")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).repartition(parts)
    frame = frame.withColumns({c: F.lit(7) for c in ("task", "at", "n", "ids", "base", "total", "begin", "spans", "sequence_id")})
    windows = concat_cut.concatenate_and_cut(frame, TOKENIZER, length)
    pieces = concat_cut.pieces(windows).collect()
    check_packing(pieces, texts, length)
    joined = concat_cut.sequences(windows).collect()
    assert sorted(r.sequence_id for r in joined) == sorted({r.sequence_id for r in pieces})
    assert all(r.n_tokens == len(r.ids) // 4 == sum(s.length for s in r.spans) for r in joined)
    crc = {(r.sequence_id, s.offset): zlib.crc32(r.ids[4 * s.offset : 4 * (s.offset + s.length)]) for r in joined for s in r.spans}
    assert crc == {(r.sequence_id, r.offset): r.ids_crc32 for r in pieces}


def test_packing_without_broadcast_and_without_rows(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"text number {i}", "en", "s", 0) for i in range(60)], DOCS).repartition(6)
    monkeypatch.setattr(concat_cut, "MAX_BROADCAST_TASKS", 0)
    rows = concat_cut.pieces(concat_cut.concatenate_and_cut(frame, TOKENIZER, 32)).collect()
    check_packing(rows, [(i, f"text number {i}") for i in range(60)], 32)
    assert concat_cut.pieces(concat_cut.concatenate_and_cut(frame.limit(0), TOKENIZER)).count() == 0


def test_encoder_equals_the_library_also_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(encoding, "MAX_WORDS", 5)
    monkeypatch.setattr(encoding, "BLOCK", 64)
    own, ids = encoding.TextEncoder(open(TOKENIZER, encoding="utf-8").read()), library_ids()
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + [" ".join(rng.choice(["the", "Don't", "x1y", "<|endoftext|>", "日本", "ÉÀ", "_a-b_"]) for _ in range(300)) for _ in range(20)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == ids(t)


def test_tail_is_cut_at_powers_of_two():
    assert [concat_cut.place(p, 21, 8) for p in (0, 8, 15, 16, 19, 20)] == [(0, 0, 8), (1, 0, 8), (1, 7, 8), (2, 0, 4), (2, 3, 4), (3, 0, 1)]


# ---------------------------------------------------------------- merkle
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(nodes):
    """Root, and for each leaf the siblings left and right at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p - p % 3
            paths[k].append((nodes[first:p], nodes[p + 1 : first + 3]))
        at = [p // 3 for p in at]
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def manifest_by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text); the query's result as a sorted list."""
    groups = defaultdict(list)
    for r in rows:
        tampered = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")
        groups[r[1]].append(((r[0] is not None, r[0] or 0, leaf_by_hand(r[0], r[1], r[2], r[3], r[4]), leaf_by_hand(*r[:4], tampered)), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_by_hand([k[2] for k, _ in sorted(groups[s], key=lambda x: x[0])]) for s in order}
    root, above = tree_by_hand([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (key, doc), path in zip(sorted(groups[s], key=lambda x: x[0]), trees[s][1]):
            folded = key[3]
            for left, right in path + up:
                folded = sha(*left, folded, *right)
            proof = sha(*(h for left, right in path + up for h in left + right))
            out.append((str(doc), key[2], trees[s][0], root, proof, folded, folded == root))
    return sorted(out)


FIELDS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def as_listed(rows):
    return sorted((str(r.doc_id), *(r[c] for c in FIELDS[1:])) for r in rows)


def test_manifest_equals_brute_force(spark):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in read(spark, SF, "documents").collect()]
    got = QUERIES["op12_merkle_manifest"](spark, SF)
    assert got.columns[0] == "doc_id" and set(FIELDS) <= set(got.columns)
    assert as_listed(got.collect()) == manifest_by_hand(rows)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_of_edge_rows(spark, tmp_path, monkeypatch, levels):
    rows = [(i, "hot", "en", 3, f"line {i}\nnext") for i in range(100)]
    rows += [(i, s, None, None, None) for i, s in enumerate([None, "", "é", "z", None, "lone"])]
    rows += [(None, "hot", None, 1, "a\nb"), (5, "hot", "en", 3, "another text\n"), (5, "hot", "en", 3, "another text\n"), (-7, "é", "x", 0, ""), (7, "z", "x", 9, "y\n" * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit(7) for c in ("pos", "n", "group", "leaf", "block", "hash", "found", "group_pos")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    build, prove = merkle.build, merkle.prove
    monkeypatch.setattr(merkle, "build", lambda *a, **k: build(*a, **k, levels=levels))
    monkeypatch.setattr(merkle, "prove", lambda *a: prove(*a, levels=levels))
    assert as_listed(QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()) == manifest_by_hand(rows)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    df = spark.createDataFrame([(4, "s", "en", 3, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    for name, part in (("one", df), ("none", df.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = manifest_by_hand([tuple(r) for r in part.collect()])
        assert as_listed(QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/{name}").collect()) == want


def test_multiproof_of_a_subset(spark):
    rows = [(i, "ab"[i % 7 == 0], sha(str(i))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumns({"found": F.col("leaf"), "pos": F.lit(7), "n": F.lit(7)})
    manifest = merkle.build(df, "source", "doc_id", "leaf", keep=["found"], levels=3)
    got = merkle.prove(manifest, "leaf", "found", "doc_id", subset=F.col("doc_id").isin([0, 1, 2, 50, 51, 399]), levels=3).collect()
    order = {s: [r[2] for r in rows if r[1] == s] for s in "ab"}
    trees = {s: tree_by_hand(order[s]) for s in "ab"}
    root, above = tree_by_hand([trees["a"][0], trees["b"][0]])
    assert {r.id for r in got} == {0, 1, 2, 50, 51, 399} and all(r.verified and r.root == root for r in got)
    for r in got:
        s = "ab"[r.id % 7 == 0]
        path = trees[s][1][order[s].index(sha(str(r.id)))] + above["ab".index(s)]
        assert r.proof == [h for left, right in path for h in left + right]


def test_missing_coordinates_are_the_least():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 10, 100, 243, 244):
        for _ in range(20):
            held = rng.sample(range(n), rng.randint(1, n))
            count, level, known, want = n, 0, set(held), set()
            while count > 1:  # siblings on some path that no leaf of the set lies below
                for p in known:
                    first = p - p % 3
                    want |= {(level, q) for q in range(first, min(first + 3, count)) if q not in known}
                known, count, level = {p // 3 for p in known}, -(-count // 3), level + 1
            got = merkle.missing_coordinates(held, n)
            assert len(got) == len(set(got)) and set(got) == want


# ---------------------------------------------------------------- prefix trie
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_by_hand(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in below)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node], sha(ends)))
    return sorted(out)


def test_trie_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in read(spark, sf, "conversations").collect()]
        got = QUERIES["op13_prefix_trie"](spark, sf)
        assert got.columns == COLUMNS
        assert sorted(tuple(r) for r in got.collect()) == trie_by_hand(rows)


def odd_conversations():
    rng = random.Random(6)
    texts = ["", None, "a", "b", "🙂 é", "long " * 3000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(0, 40), 100, 103, 104, 205, 2**40] for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "same first words") for c in range(300, 420) for t in range(3)]  # copies, also without a base
    rows += [(7, None, "user", "no turn number"), (7, None, "a", "another"), (7, 2, None, None), (7, 2, None, None), (None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(150, t, "user", f"turn {t % 5}") for t in range(400)] + [(151, t, "user", f"turn {t % 5}") for t in range(300)]
    return rows


@pytest.mark.parametrize("seed, primes, ranges", [(0, prefix_trie.PRIMES, 4096), (5, prefix_trie.PRIMES, 16), (1, (1009, 1013, 61, 67), 4096)])
def test_trie_of_edge_rows_also_after_collisions(spark, tmp_path, monkeypatch, seed, primes, ranges):
    monkeypatch.setattr(prefix_trie, "RANGE", ranges)
    monkeypatch.setattr(prefix_trie, "HUBS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    trie = prefix_trie.trie
    monkeypatch.setattr(prefix_trie, "trie", lambda *a, **k: trie(*a, **k, seed=seed, primes=primes))
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({c: F.lit(7) for c in ("depth", "k1", "a", "i", "range", "n", "first", "parent", "rn")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == trie_by_hand(rows)


def test_trie_notices_collisions(spark):
    df = spark.createDataFrame([(c, 0, "user", f"text {c}") for c in range(100, 140)], "conv_id long, turn long, role string, text string")
    turns, sound = prefix_trie.stored_turns(df, 0, (5, 5, 5, 5))
    rebuilt = prefix_trie.rebuilt_turns(turns, lambda c: c, lambda c: F.lit(0), 1, 0, (5, 5, 5, 5))
    assert sound and not prefix_trie.prefix_nodes(rebuilt)[1]


def test_trie_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect() == []


# ---------------------------------------------------------------- mended rows
def test_texts_are_counted_and_packed_in_one_pass(spark):
    ids = library_ids()
    df = spark.createDataFrame([(i, t, 7, 7) for i, t in enumerate([*ODD, "w " * 20_000])], "doc_id long, text string, size int, piece int")
    got = defaultdict(list)
    for r in packing.pack_texts(df, TOKENIZER, lengths=(64, 256)).collect():
        got[r.doc_id].append(r)
    for r in df.collect():
        assert sum(p.n_tokens for p in got[r.doc_id]) == len(ids(r.text))
    bins = defaultdict(int)
    for p in (p for ps in got.values() for p in ps if p.bin_id is not None):
        bins[p.bin_id, p.bin_length] += p.n_tokens
    assert all(n <= length for (_, length), n in bins.items())


def test_digits_are_no_letters(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½ ² ①", "٣ 12 _", "Ⅷ", "hello there", "ª"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == got[4] == "en"


def test_large_small_and_mixed_length_vectors_are_found(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-300, 0.0]), (50, [0.0, 3.0, 4.0]), (51, [0.0, 4.0, 3.0]), (100, [5e-324, 5e-324])]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", k=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 12)))
    assert sorted(got[0]) == [(1, 2, 1.0), (2, 1, round(0.5**0.5, 12)), (3, 100, round(0.5**0.5, 12))]
    assert sorted(got[50]) == [(1, 51, 0.96)] and [x[1] for x in sorted(got[100])] == [1, 0, 2]


def test_quality_with_one_rare_label(spark):
    texts = [f"plain words number {i} in a row" for i in range(60)] + ["$$$ ### !!!"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    for rare in range(0, 61, 12):
        labels = spark.createDataFrame([(i, int(i != rare)) for i in range(61)], "doc_id long, quality int")
        assert all(0 <= r.score <= 1 for r in quality.score(docs, labels, rounds=1).collect())
