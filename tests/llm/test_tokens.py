"""Token files, byte-level BPE and the language model against libraries and plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import tiktoken
from tokenizers import Tokenizer

from tabloom.llm import bpe, kneser_ney, pretokens, simple8b, token_files
from tabloom.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
PARTS = ["'s", "'t", "'re", "'ll", "'d", "'", '"', " ", "  ", "\n", "\t", "a", "ll", "re", "é", "ß", "1", "22", "!", "?!", "'S",
         "日", "本", " ", "　", "w", "xyz", "д", "😀", "́", "ok", "\x1c", "\x85", "²", "ª", ""]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    return [*texts, "a" * 3000, " " * 200 + "x", "\n\n\n", ""]


@pytest.fixture(scope="module")
def library():
    tokens = bpe.read_ranks(bpe.VOCABULARY)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )


def split(ids, counts):
    upto = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])]


def test_bpe_equals_the_rank_library(odd_texts, library):
    coder = bpe.Codec()
    got = split(*coder.encode(odd_texts))
    assert got == [library.encode_ordinary(t) for t in odd_texts]
    assert all(coder.decode(ids) == text.encode() for ids, text in zip(got, odd_texts))


def test_file_encoder_equals_its_library(odd_texts):
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    texts = [*odd_texts, "a <|endoftext|> b", "<|endoftext|>"]
    coder = token_files.Encoder(token_files.VOCABULARY)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [token_files.END_ID] for t in texts]
    assert split(*coder.encode(texts)) == want
    assert split(*coder.encode(texts)) == want  # from what it remembers


def test_pretokens_are_the_patterns_matches(odd_texts):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    found = pretokens.Pretokens(odd_texts)
    for k, text in enumerate(odd_texts):
        mine = [found.distinct[c].decode() for c in found.codes[found.first[k] : found.first[k + 1]]]
        assert mine == pattern.findall(text)


def test_bpe_query(docs, cases, library):
    rows = bpe.encode_and_decode(docs).collect()
    got = Counter(tuple(r) for r in rows)
    want = Counter()
    for i, t, _ in cases:
        ids = library.encode_ordinary(t or "")
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want


def test_bpe_keeps_columns(docs, cases, library):
    out = bpe.encode(docs.withColumnRenamed("_row", "ids"))
    assert out.columns == [c for c in docs.columns if c != "_row"] + ["ids"]
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in out.collect())


@pytest.mark.parametrize("n", [0, 1, 5, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("bits", [0, 1, 8, 16, 30, 60, 63])
def test_simple8b_round_trip(n, bits):
    rng = np.random.default_rng(n + bits)
    values = rng.integers(0, 1 << bits, n, dtype=np.uint64)
    values[rng.random(n) < 0.3] = 1
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, n) == values).all()
    for block in range(len(offsets) - 1):  # each block by its offset alone
        size = min(simple8b.BLOCK, n - block * simple8b.BLOCK)
        part = simple8b.decode(words[offsets[block] : offsets[block + 1]], offsets[block : block + 2] - offsets[block], size)
        assert (part == values[block * simple8b.BLOCK :][:size]).all()


def test_simple8b_layout():
    assert simple8b.encode(np.ones(60))[0].tolist() == [((1 << 60) - 1) << 4 | 1]
    words, offsets = simple8b.encode(np.array([1 << 62], np.uint64))
    assert words.tolist() == [simple8b.ESCAPE, 1 << 62] and offsets.tolist() == [0, 2]


def in_order(cases):
    return sorted(((i, t or "") for i, t, _ in cases), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("file_bytes", [600, 1 << 25])
def test_token_files(spark, docs, cases, file_bytes):
    folder = scratch_path(spark, "tokens-test")
    manifest = token_files.write_files(docs, folder, file_bytes=file_bytes)
    rows = token_files.read_files(manifest, folder).collect()
    tokenizer, want, start = Tokenizer.from_file(token_files.VOCABULARY), [], 0
    for i, text in in_order(cases):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    files = sorted(manifest.collect(), key=lambda r: r["range"])
    assert sum(f["ids"] for f in files) == start and (file_bytes > 600 or len(files) > 2)
    system, path = pafs.FileSystem.from_uri(folder)
    ids = []
    for f in files:
        with system.open_input_file(f"{path}/{f['file']}") as file:
            reader = token_files.Reader(file)
            assert reader.doc_ids[0] == f["first_doc"] and len(reader.doc_ids) == f["documents"]
            ids += [int(i) for run in reader.runs(blocks=1) for i in run]
    assert len(ids) == start and ids.count(0) >= len(cases)


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute_force(train, texts, order):
    """The model from the textbook definition, with dictionaries."""
    sequences = [["<s>\n"] * (order - 1) + WORD.findall(t.translate(FOLD)) + ["</s>\n"] for t in train]
    counts = {n: Counter() for n in range(1, order + 1)}
    left = defaultdict(set)
    for s in sequences:
        for i in range(order - 1, len(s)):
            for n in range(1, order + 1):
                gram = tuple(s[i - n + 1 : i + 1])
                counts[n][gram] += 1
                if n < order:
                    left[gram].add(s[i - n])
    adjusted = {
        n: {g: c if n == order or g[0] == "<s>\n" else len(left[g]) for g, c in counts[n].items()} for n in counts
    }
    often = {n: Counter(min(c, 5) for c in adjusted[n].values()) for n in adjusted}
    discount = {n: kneser_ney.discounts(*(often[n][k] for k in (1, 2, 3, 4))) for n in adjusted}
    contexts = {n: defaultdict(lambda: [0, 0, 0, 0]) for n in adjusted}
    for n in adjusted:
        for g, c in adjusted[n].items():
            contexts[n][g[:-1]][0] += c
            contexts[n][g[:-1]][min(c, 3)] += 1
    kinds, total = len(counts[1]), sum(counts[1].values())
    for text in texts:
        s, logs, base, known = ["<s>\n"] * (order - 1) + WORD.findall(text.translate(FOLD)) + ["</s>\n"], 0.0, 0.0, 0
        for i in range(order - 1, len(s)):
            p = 1 / (kinds + 1)
            for n in range(1, order + 1):
                gram = tuple(s[i - n + 1 : i + 1])
                if gram[:-1] in contexts[n]:
                    whole, *some = contexts[n][gram[:-1]]
                    c = adjusted[n].get(gram, 0)
                    off = (0, *discount[n])[min(c, 3)]
                    p = (c - off) / whole + sum(d * k for d, k in zip(discount[n], some)) / whole * p
            logs, known = logs + math.log10(p), known + (counts[1][s[i],] > 0)
            base += math.log10((counts[1][s[i],] + 1) / (total + kinds + 1))
        yield len(s) - order + 1, known, total, base, logs


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney(docs, cases, order):
    rows = kneser_ney.train_and_score(docs, order=order, shard_bytes=20_000).collect()
    train = [t or "" for i, t, _ in cases if not held_out(i)]
    want = sorted((i or -1, held_out(i), *x) for (i, _, _), x in zip(cases, brute_force(train, [t or "" for _, t, _ in cases], order)))
    got = sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_kneser_ney_probabilities_sum_to_one(spark):
    texts = ["a b a b c", "a c d", "b b a", "d a b c a"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneser_ney.train(frame, order=3)
    words = ["a", "b", "c", "d", "never"]
    word = lambda w: int(kneser_ney.hashes([w.encode()])[0])
    for history in (("a", "b"), ("d", "never"), ("b", "c")):
        ends = [word(w) for w in words] + [kneser_ney.END]
        sequence = np.array([h for e in ends for h in (*map(word, history), e)], dtype=np.uint64)
        logs, _ = kneser_ney.token_scores(model, sequence, np.arange(2, len(sequence), 3))
        assert abs(np.sum(10.0**logs) - 1) < 1e-12


def test_kneser_ney_without_training_rows(spark, nothing):
    alone = [i for i in range(40) if held_out(i)][:2]
    frame = spark.createDataFrame([(i, "a b") for i in alone], "doc_id long, text string")
    rows = kneser_ney.train_and_score(frame).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert kneser_ney.train_and_score(nothing).count() == 0


def test_empty_tables(nothing):
    assert bpe.encode_and_decode(nothing).count() == 0 and bpe.encode(nothing).count() == 0
    assert token_files.token_files(nothing).count() == 0


def test_a_hot_context_is_split_over_shards():
    """The n-grams of one context go to all shards, and its sums come together again."""
    rng = np.random.default_rng(4)
    last = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    columns, ones = [np.full(len(last), 9, np.uint64), last], np.ones(len(last), np.int64)
    columns, context, counts, _ = kneser_ney._merge(columns, ones, ones)
    dealt = kneser_ney._dealt(columns, context, counts, counts, 8).to_pydict()
    sizes = [len(a) // 4 for a in dealt["adjusted"]]
    assert sorted(dealt["shard"]) == list(range(8)) and sum(sizes) == len(last) and max(sizes) < len(last) / 5
    shard, contexts, sums = kneser_ney._partial_sums(context, counts, 8)
    assert len(shard) == 1 and np.frombuffer(contexts[0], np.uint64).tolist() == [context[0]]
    assert np.frombuffer(sums[0], np.int64).tolist() == [len(last), len(last), 0, 0]


def test_counts_of_one_byte_and_beyond():
    values = np.array([0, 1, 254, 255, 256, 2**40, 3])
    raw = kneser_ney.pack(values)
    assert len(raw) == 7 + 3 * 8 and kneser_ney.unpack(raw, 7).tolist() == values.tolist()
    assert kneser_ney.unpack(kneser_ney.pack(np.zeros(0)), 0).tolist() == []


@pytest.mark.parametrize("n", [0, 1, 31, 5000])
@pytest.mark.parametrize("short", [True, False])
def test_packed_files(tmp_path, n, short):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    counts = rng.integers(1, 400, len(keys))
    name = kneser_ney._write(str(tmp_path), "t", kneser_ney.packed(keys, [counts, counts * 2**33], short))
    file = kneser_ney.Packed(str(tmp_path), name)
    at, there = file.find(keys[::-1])
    assert there.all() and at.tolist() == list(range(len(keys)))[::-1]
    if n:
        assert file.column(0, at).tolist() == counts[::-1].tolist()
        assert file.column(1, at).tolist() == (counts * 2**33)[::-1].tolist()
    assert not file.find(rng.integers(0, 2**64, 1000, dtype=np.uint64))[1].any()
