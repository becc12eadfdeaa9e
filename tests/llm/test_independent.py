"""The training-data operators against definitions written down here anew, and cases that once went wrong."""

import random
import string
import sys
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coverlet.llm import bigru, context_mixing, near_dedup, queries, secrets
from coverlet.llm.context_mixing import score_texts
from coverlet.llm.near_dedup import near_duplicates
from coverlet.llm.order_minhash import edited_fingerprints, fingerprints, likeness, sketch
from coverlet.llm.packing import Limits, Packer, Piece, pack
from coverlet.llm.sharding import ShardStore
from coverlet.llm.tokens import ByteEncoder, ChunkEncoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- near duplicates ---


def alike(share, n, seed):
    """n texts that share about `share` of their shingles with each other."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"b{k}" for k in range(200)]
        for k in rng.sample(range(0, 200, 5), int((1 - share) * 40)):
            words[k : k + 3] = [f"z{i}.{k}"] * 3
        rows.append((i, " ".join(words)))
    return rows


def components_of(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in range(len(rows))}


@pytest.mark.parametrize("share", [0.66, 0.93])
def test_alike_texts(spark, monkeypatch, share):
    """Many texts that are nearly alike are grouped right, also in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "SHINGLES", 4000)
    rows = alike(share, 150, 3)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(rows)


def test_pairs_share_a_bucket(spark, monkeypatch):
    """Texts of one template, far from being copies: what is compared is what shares a bucket, not all with all."""
    seen = []
    screened = near_dedup._open_buckets
    monkeypatch.setattr(near_dedup, "_open_buckets", lambda *a: seen.append(screened(*a)) or seen[-1])
    near_duplicates(spark.createDataFrame(alike(0.4, 200, 5), "doc_id long, text string")).count()
    each = seen[0].groupBy("key", "i", "j").agg(F.sum("side").alias("members"), F.sum(1 - F.col("side")).alias("outliers"))
    compared = each.agg(F.sum(F.col("members") * F.col("outliers"))).first()[0] or 0
    # A band is shared with probability of about 0.25^4 or less, of 32 bands.
    assert compared < 200 * 200


# --- fingerprints ---


def chance_of_equal_tuples(a, b, k=8, rounds=1500):
    """How often the two least occurrence-numbered k-mers of two texts, in text order, are equal under random orders."""
    rng = random.Random(11)

    def kmers(text):
        count, out = Counter(), []
        for at in range(len(text) - k + 1):
            mer = text[at : at + k]
            out.append((mer, count[mer]))
            count[mer] += 1
        return out

    x, y = kmers(a), kmers(b)
    every, equal = sorted(set(x) | set(y)), 0
    for _ in range(rounds):
        rank = dict(zip(every, rng.sample(range(len(every)), len(every)), strict=True))
        first = [sorted(sorted(range(len(m)), key=lambda i, m=m: rank[m[i]])[:2]) for m in (x, y)]
        equal += [x[i] for i in first[0]] == [y[i] for i in first[1]]
    return equal / rounds


def test_order_minhash_estimates_its_definition():
    rng = random.Random(9)
    base = "".join(rng.choice("abcd") for _ in range(300))
    half = base[150:] + base[:150]
    few = "".join(rng.choice("abcd") if rng.random() < 0.02 else c for c in base)
    repeated = base[:60] * 5
    for a, b in ((base, base), (base, half), (base, few), (repeated, base), (repeated, repeated[:240])):
        assert likeness(sketch(a, 140), sketch(b, 140)) == pytest.approx(chance_of_equal_tuples(a, b), abs=0.15)


def test_edited_values(spark):
    rows = [(2, None), (1, "abcdefgh"), (1, "abcdefgh"), (3, "é😀")]
    got = sorted((r.doc_id, r.n_chars, r.near_next) for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x[:2] for x in got] == [(1, 8), (1, 8), (2, 0), (3, 2)]
    assert 1.0 in (got[0][2], got[1][2])


# --- context mixing ---


def test_counts_of_others():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 30, 40)
    starts = np.cumsum(sizes) - sizes
    learns = rng.random(40) < 0.7
    words = rng.integers(0, 6, sizes.sum()).astype(np.uint64)
    pair, triple = context_mixing.gram_keys(words, starts, 40)
    docs = [words[s : s + n].tolist() for s, n in zip(starts, sizes, strict=True)]
    for keys, width in ((pair, 2), (triple, 3)):
        grams = [[tuple(([None, None, *d])[k + 3 - width : k + 3]) for k in range(len(d))] for d in docs]
        total = Counter(g for gs, use in zip(grams, learns, strict=True) if use for g in gs)
        known, counts = context_mixing.distinct(keys, learns)
        assert (counts.sum(), len(known)) == (sum(total.values()), len({g for gs in grams for g in gs}))
        want = [total[g] - (Counter(gs)[g] if use else 0) for gs, use in zip(grams, learns, strict=True) for g in gs]
        assert context_mixing.others(keys, learns, counts).tolist() == want


def test_packed_numbers():
    for x in ([], [0], [0, 1, 255, 256, 1 << 59], list(range(1000))):
        assert context_mixing.unpacked(context_mixing.packed(np.array(x, np.uint64)), len(x)).tolist() == x


def test_probabilities_sum_to_at_most_one(spark):
    """Texts of one word or none are disjoint cases; among training texts of 0 to 11 words they are about a sixth."""
    rng = random.Random(4)
    vocab = [f"{a}{k}" for a in "abc" for k in range(15)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 12)))) for k in range(150)]
    rows += [(1000 + k, w) for k, w in enumerate(vocab)] + [(2000, "")]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).where("doc_id >= 1000").collect()
    assert 0.01 < sum(10.0**r.score for r in got) <= 1.0 + 1e-6


def test_repeated_texts_cost_less(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(80))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    got = {r.doc_id: r.bits_per_byte for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 102).collect()}
    # The copy of 2 is held out, so 2 has no copy among the training texts, but 102 has.
    twins, others = {0, 1, 3, 4, 100, 101, 102, 103, 104}, {2, *range(5, 60)}
    assert max(got[k] for k in twins) < 0.5 * min(got[k] for k in others)


def test_shards_and_chunks_do_not_matter(spark, monkeypatch):
    rows = [(k, " ".join(f"v{(k * j) % 50}" for j in range(k % 40))) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    one = {r.doc_id: r.score for r in score_texts(frame, F.col("doc_id") % 3 != 0).collect()}
    monkeypatch.setattr(context_mixing, "CHUNK", 500)
    monkeypatch.setattr(context_mixing, "SHARD_BYTES", 1000)
    many = {r.doc_id: r.score for r in score_texts(frame, F.col("doc_id") % 3 != 0).collect()}
    assert many == pytest.approx(one, rel=1e-5)


def test_counts_are_written_in_small_groups_and_compressed_once(spark, monkeypatch):
    """A task that writes or reads counts holds a group of rows, not its whole part of the table."""
    kept, stored = [], context_mixing.stored
    monkeypatch.setattr(context_mixing, "stored", lambda df, name, *more, **options: kept.append((name, stored(df.coalesce(1), name, *more, **options))) or kept[-1][1])
    monkeypatch.setattr(context_mixing, "CHUNK", 500)
    monkeypatch.setattr(context_mixing, "GROUP_BYTES", 1 << 16, raising=False)
    rng = random.Random(3)
    rows = [(k, " ".join(f"v{rng.randrange(9000)}" for _ in range(100))) for k in range(300)]
    score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), F.col("doc_id") % 3 != 0)
    (counts,) = [df for name, df in kept if name == "counts"]
    for file in counts.inputFiles():
        found = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
        groups = [found.row_group(k) for k in range(found.num_row_groups)]
        payload = found.schema.names.index("payload")
        assert {g.column(payload).compression for g in groups} == {"UNCOMPRESSED"}
        # The size is looked at every sixteen rows at most.
        longest = max(len(r.payload) + len(r.counts or b"") for r in counts.collect())
        assert len(groups) > 1
        assert max(g.total_byte_size for g in groups) < (1 << 16) + 17 * longest


def test_scoring_lets_token_arrays_go():
    """The peak of a large chunk, in bytes a token: 227 when every array lived until the end."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 3500)
    starts, tokens, learns = np.cumsum(sizes) - sizes, int(sizes.sum()), rng.random(3500) < 0.8
    keys = np.unique(rng.integers(0, 1 << 59, 5000).astype(np.uint64))
    seq = (len(keys) * rng.random(tokens) ** 3).astype(np.int64)
    pair, triple = context_mixing.gram_keys(keys[seq], starts, 40)
    by = {"words": np.bincount(seq[np.repeat(learns, sizes)], minlength=len(keys)), "pairs": context_mixing.distinct(pair, learns)[1], "triples": context_mixing.distinct(triple, learns)[1]}
    del pair, triple
    x = {"ids": np.arange(3500), "null": np.zeros(3500, "u1"), "sizes": sizes.astype("<i4"), "bytes": sizes * 6, "learns": learns, "seq": seq, "keys": keys, "endings": rng.integers(0, context_mixing.SYMBOLS, len(keys)), "lengths": rng.integers(1, 9, len(keys))}
    table = np.zeros((context_mixing.ROWS, context_mixing.SYMBOLS), np.float16)
    tracemalloc.start()
    got = context_mixing._scored(x, by, 40, 10_000, len(keys), table, np.ones(context_mixing.SYMBOLS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 3500
    assert peak < 200 * tokens


# --- secrets ---


def test_ownership_over_a_corpus(spark):
    rng = random.Random(2)
    values = [f"token=ab{k}cd{k * k}ef" for k in range(30)]
    rows = [(i, " ".join(rng.sample(values, rng.randrange(4))), f"s{rng.randrange(6)}" if rng.random() < 0.9 else None) for i in range(120)]
    holders = {}
    for i, text, owner in rows:
        for v in text.split():
            holders.setdefault(v, set()).add((i, owner))
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), owners=3, repos=9).collect()
    for r in got:
        text = rows[r.doc_id][1]
        spans = [s for s in r.spans if s.kind == "assign"]
        assert len(spans) == len(text.split())
        for s in spans:
            held = holders[text[s.start : s.end]]
            owners = {o for _, o in held}
            assert (s.repos, s.owners) == (len(held), len(owners))
            assert s.live == (len(owners) <= 3 and len(held) <= 9)


def test_redact_with_clashing_names(spark):
    rows = [(1, "password=hunter22 ok", "s", 5, "v", "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _values string, row string, value string")
    assert [tuple(r) for r in secrets.redact(docs).collect()] == [(1, "<REDACTED> ok", "s", 5, "v", "w", "x")]


# --- languages ---


def test_sample_is_bounded(spark, monkeypatch):
    """Rows without ids share one hash; the sample stays bounded all the same."""
    taken = []
    monkeypatch.setattr(bigru, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(bigru, "SAMPLE_BYTES", 150)
    monkeypatch.setattr(bigru, "train", lambda texts, target, labels: taken.append(texts))
    rows = [(None, f"text number {k}", "en") for k in range(300)] + [(1, "another one", None), (2, None, "fr")]
    bigru.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 1 <= len(taken[0]) <= 20
    assert sum(map(len, taken[0])) <= 150


def test_every_position_is_labelled_once():
    """Windows of any size give each position of a text to one window, with its neighbours as context."""
    data = [b"", b"a", b"abcdefghij", b"x" * 23]
    flat, begin, live, count = bigru.windows(data, 5, 2)
    cells = flat[begin + np.arange(9)[:, None]]
    assert (count.tolist(), live.sum()) == ([0, 1, 2, 5], sum(map(len, data)))
    at = 0
    for x, n in zip(data, count, strict=True):
        assert b"".join(bytes(cells[2 : 2 + live[k], k]) for k in range(at, at + n)) == x
        if n > 1:
            assert bytes(cells[7:, at]) == x[5:7]
            assert bytes(cells[:2, at + 1]) == x[3:5]
        at += n


def test_without_a_network(spark):
    docs = spark.createDataFrame([(1, "word"), (2, "12"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in bigru.keep_recognised(docs, None).collect()] == [1]


# --- packing and tokens ---


def test_ids_of_all_cased_letters():
    """Every letter that has another lower case, before every mark and in a word, gives the tokenizer's ids."""
    encoder = ChunkEncoder.at(TOKENIZER)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.lower() != c]
    texts = [f"{c}{m} a{c}{m}{m} {c}b" for c in letters for m in ".,!#|"]
    texts += [f"{a}{b}." for a in "aéİßſ" for b in map(chr, range(0x300, 0x370)) if unicodedata.combining(b)]
    got = encoder.encode([t.encode() for t in texts])
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, g, w in zip(texts, got, want, strict=True) if np.frombuffer(g, "<u4").tolist() != w]
    assert not wrong, wrong[:5]


def test_ids_of_capitals():
    """Capital words beside a special token's beginning, and capitals before every mark of their own, give the tokenizer's ids."""
    marks = [c for c in map(chr, range(0x300, 0x370))]
    texts = ["<|x Hello World", "<|endoftext|> The End.", "I\u0338\u0307!"]
    texts += [f"{c}{m} a{c}{m}." for c in string.ascii_uppercase for m in marks]
    for some in ([t] for t in texts[:3]), [texts]:
        for part in some:
            encoder = ChunkEncoder(TOKENIZER)
            want = [e.ids for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
            wrong = [t for t, g, w in zip(part, encoder.encode([t.encode() for t in part]), want, strict=True) if np.frombuffer(g, "<u4").tolist() != w]
            assert not wrong, wrong[:5]


def test_words_are_encoded_once():
    """A word before marks is the word that stands alone: no chunk is kept, and paid for, with its marks."""
    encoder = ChunkEncoder(TOKENIZER)
    text = "apple apple, apple. apple!! pear; pear"
    got = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(encoder.ids) == {b"apple", b"pear", b",", b".", b"!!", b";"}


def test_a_cut_counts_its_rest_alone():
    """Cuts do not count all waiting kinds again: look-ups stay in proportion to pieces, not to pieces times kinds."""

    class Counted(dict):
        looks = 0

        def get(self, *key):
            Counted.looks += 1
            return super().get(*key)

    packer = Packer(Limits(512, 64, 384))
    packer.waiting = Counted()
    for i in range(300, 500):
        packer.add(Piece(i, 0, b"\1\0\0\0" * i, i // 2, i))
    made = list(packer.sequences(1))
    assert sum(len(p) for s in made for p in s) == sum(range(300, 500))
    assert sum(map(len, made)) > 200  # some were cut
    assert Counted.looks <= 4 * sum(map(len, made))


def test_loss_is_a_demand_of_its_own(spark):
    """Sequences are full although none may bear loss on more than three quarters, and half of all tokens do."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 40, 400, 3000))))) for i in range(150)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), TOKENIZER, limits=Limits(512, 64, 384), loss_share=0.5).collect()
    sequences = {}
    for r in got:
        tokens, loss = sequences.get(r.sequence_id, (0, 0))
        sequences[r.sequence_id] = (tokens + r.length, loss + r.loss_tokens)
    assert max(loss for _, loss in sequences.values()) == 384
    assert len(sequences) <= -(-sum(tokens for tokens, _ in sequences.values()) // 512) + 1
    assert sum(tokens < 512 for tokens, _ in sequences.values()) <= 3
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for pieces in by.values():
        assert sum(p.loss_tokens for p in pieces) == pieces[0].doc_tokens // 2


def test_token_counts(spark):
    """The rolled-up totals against counts made here, text by text."""
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    tokenizer, parts = Tokenizer.from_file(TOKENIZER), ByteEncoder.at(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        for version, n in (("word_bpe_49k", words + 1), ("byte_bpe_50k", len(parts.encoding.encode_ordinary(r.text or "")))):
            key = (r.source, r.lang, version)
            want[key, "docs"] += words >= 5
            want[key, "tokens"] += n if words >= 5 else 0
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op8_token_counts(spark, folder).collect()}
    assert got == {k: (want[k, "docs"], want[k, "tokens"]) for k, _ in want}


# --- shards and ids ---


def test_empty_shards(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    store = ShardStore(spark, f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        store.read()
    store.append(frame)
    store.compact()
    assert (store.read().columns, store.read().count()) == (["doc_id", "text", "shard"], 0)
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 100_000)]
    store.append(spark.createDataFrame(rows, frame.schema))
    assert sorted(map(str, store.read().drop("shard").collect())) == sorted(map(str, spark.createDataFrame(rows, frame.schema).collect()))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1, 2)], "doc_id long, other int"))
    assert queries.op7_sharding(spark, _tables(tmp_path, frame)).count() == 0


def _tables(folder, documents):
    documents.write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "b", "s")], "doc_id string, text string, source string")
    for run in (near_duplicates, fingerprints, edited_fingerprints, secrets.find_secrets, lambda d: score_texts(d, F.lit(True)), lambda d: bigru.label_languages(d, None), lambda d: pack(d, TOKENIZER)):
        with pytest.raises(TypeError):
            run(docs)
