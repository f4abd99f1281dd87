"""Each operator against its plain version; nulls, empty and repeated rows, ties, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidewheel.llm import bpe, chat_format, license_scan, mixing, ngram_join, quality_rules, queries, suffix_dedup, topk_search, toxicity, url_filter
from tidewheel.llm._text import Slice, slices

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"


def made(seed, n=80, words=60):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 9, 20, words]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    rng.shuffle(out)
    return [*enumerate(out[:n]), (n, None), (n + 1, ""), (n + 2, " \n")]


# ------------------------------------------------------------------ 1 byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken_on_any_text(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "the", "ab", "é", "漢", "  ", "\n", " th", "ing", "'s", "12", "!", "\x1c", "\u00a0"]), max_size=30))
def test_bpe_equals_tiktoken_on_mixtures(codec, reference, parts):
    assert codec.encode("".join(parts)) == reference.encode_ordinary("".join(parts))


def test_bpe_tells_all_code_points_apart_as_tiktoken_does(codec, reference):
    """Letters, numbers and white space by tiktoken itself, over all code points; texts of those that tables differ on."""
    want = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for first in range(0, 0x110000, 0x4000):
            some = "".join(map(chr, (c for c in range(first, first + 0x4000) if not 0xD800 <= c < 0xE000)))
            want[[ord(c) for c in probe.decode_bytes(probe.encode_ordinary(some)).decode()]] = kind
    assert np.flatnonzero(bpe.character_kinds() != want).tolist() == []
    for first, last in bpe.LATER:
        for c in {first, last, (first + last) // 2}:
            text = f"a{chr(c)}b1{chr(c)} {chr(c)}a"
            assert codec.encode(text) == reference.encode_ordinary(text)


def test_bpe_is_linear_on_one_long_piece(codec, reference):
    for text in ("a" * 20_000, "ab" * 9_000, "漢" * 5_000):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_bpe_pairs_agree_with_merging(codec):
    rng = random.Random(5)
    made = [t for t in codec.ranks if len(t) == 1 or t in codec.halves]
    some = sorted(made, key=codec.ranks.get)[:600]
    pairs = [(rng.choice(some), rng.choice(some)) for _ in range(3000)] + [(rng.choice(made), rng.choice(made)) for _ in range(1000)]
    pairs += [codec.halves[t] for t in made[300:800]]
    for _ in range(2):  # the second time from the memo
        for x, y in pairs:
            assert codec.compatible(x, y) == (codec._merge(x + y) == [x, y])


def test_bpe_batches_blocks_and_memos(codec, reference, monkeypatch):
    """Long texts in blocks, memos that start again, pieces of every length: as the library has them."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 22))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) + rng.choice(["", " ", "\n", "x'll", "  \t"]) for _ in range(60)]
    texts += ["", "é" * 900, "q" * 3000, "ab 'sa 'll's''s don't\n's", " " * 500, "a" * 70 + " " + "b" * 70]
    monkeypatch.setattr(bpe, "BLOCK", 512)
    monkeypatch.setattr(bpe, "KNOWN_IDS", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for s in [Slice(batch, "text"), *slices(iter([batch]), "text", 512)]:
        offsets, ids = codec.encode_slice(s)
        for i in range(s.n):
            text = s.text(i).decode()
            assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(text)
            assert codec.decode(ids[offsets[i] : offsets[i + 1]]) == text.encode()


def test_bpe_other_patterns():
    """A pattern whose pieces cross spaces is matched by the regex engine."""
    pattern = r"[a-z]+ [a-z]+|\s|."
    ranks = bpe.read_ranks(PATH)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("in the end of it all, é", "the the the", ""):
        assert bpe.BytePairCodec(ranks, pattern).encode(text) == other.encode_ordinary(text)
    with pytest.raises(ValueError, match="leaves"):
        bpe.BytePairCodec(ranks, r"[a-z]+").encode("a b")


def test_bpe_query_columns(spark, reference, tmp_path):
    """Every contract column of the registered query, with nulls, repeats, a very long text and other columns."""
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", None), (1, "Hello wörld", "y"), (None, "a  b\n", "z"), (4, "word " * 200_000 + "e" * 9_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op1_byte_bpe"](spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_bpe_frames(spark):
    df = spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld")], DOCS).withColumn("ids", F.lit("clash"))
    tokens = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, PATH, public_tokenizers.PATTERN)
    assert [bytes(r["decoded"]).decode() for r in back.orderBy("doc_id").collect()] == ["Hello wörld", "Hello wörld", "", ""]
    digest = bpe.round_trip(df, PATH, public_tokenizers.PATTERN)
    assert digest.count() == 4 and bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ 2 n-gram Jaccard join


@pytest.mark.parametrize(("n", "percent", "grams"), [(3, 90, 2_000_000), (3, 90, 200), (5, 80, 400), (2, 60, 100)])
def test_join_equals_brute_force(spark, n, percent, grams):
    rows = made(5)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), n=n, percent=percent, block_grams=grams)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.components(rows, n, percent)
    if grams == 400:  # several buckets a task
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), n=n, percent=percent, bucket_grams=50)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.components(rows, n, percent)


@pytest.mark.parametrize(("n", "percent", "grams"), [(3, 90, 2_000_000), (3, 90, 60), (2, 60, 100)])
def test_links_equal_brute_force(spark, n, percent, grams):
    rows = made(5) + [(900 + k, " ".join(f"v{j}" if j % 40 != k else f"z{k}" for j in range(60 + k))) for k in range(14)]
    rows += [(950 + k, rows[-1 - k % 3][1].upper()) for k in range(5)]
    df = spark.createDataFrame(rows + rows[-8:], DOCS)
    want, sets = brute.links(rows, n, percent), {i: frozenset(brute.shingles(t, n)) for i, t in rows}
    got = ngram_join.jaccard_components(df, n=n, percent=percent, block_grams=grams, links=True).collect()
    assert {r["id"]: r["n_links"] for r in got} == {i: sum(i in pair for pair in want) for i in sets}
    assert len(got) == len(rows) + 8
    least: dict = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    pairs = {(a, b): o for (a, b), o in want.items() if least[sets[a]] == a and least[sets[b]] == b}
    found = ngram_join.jaccard_links(df, n=n, percent=percent, block_grams=grams).collect()
    assert {(r["a"], r["b"]): r["overlap"] for r in found} == pairs and len(found) == len(pairs)


def test_linked_pairs_of_dense_and_rare_columns():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 80, replace=False)
    sets = [np.unique(np.append(base[rng.random(80) < 0.97], rng.choice(300, 3) + 20_000)).astype(np.uint64) for _ in range(60)]
    sets += [np.unique(np.append(np.arange(50) + 30_000 + 100 * (k // 2), k)).astype(np.uint64) for k in range(20)]
    side = 1 + np.arange(80) % 2
    for sides in (np.zeros(80, int), side):
        got = {(i, j): o for block in ngram_join.linked_pairs(sets, sides, 85) for i, j, o in zip(*(x.tolist() for x in block), strict=True)}
        want = {}
        for i in range(80):
            for j in range(80):
                o = len(np.intersect1d(sets[i], sets[j]))
                if o and 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o) and (i < j if not sides.any() else sides[i] < sides[j]):
                    want[i, j] = o
        assert got == want and len(want) > 20


def test_join_edges(spark):
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (1, "A B  C"), (9, None)], DOCS).withColumn("n", F.lit(1))
    got = sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, n=3, percent=90).collect())
    assert [g[:3] for g in got] == [(False, 1, 1), (False, 3, 1), (False, 3, 1), (False, 9, 0), (True, 0, 1)]
    assert [g[3] for g in got[:4]] == [1, 1, 1, 9]
    counted = ngram_join.jaccard_components(df, n=3, percent=90, links=True).collect()
    assert sorted((r["id"] or 0, r["n_links"]) for r in counted) == [(0, 2), (1, 1), (3, 1), (3, 1), (9, 0)]
    assert ngram_join.jaccard_links(df.limit(0)).count() == 0
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0 == ngram_join.jaccard_components(df.limit(0), links=True).count()


def test_tile_links_whatever_the_order():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.choice(10_000, 60, replace=False)
    sets = [np.unique(np.concatenate([base[: 60 - k], 20_000 + np.arange(100 * k, 100 * k + k)])).astype(np.uint64) for k in range(12)]
    sets += [np.unique(rng.choice(50_000, 50)).astype(np.uint64) for _ in range(5)]
    label = ngram_join.link_tile(sets, 90)
    want = [[len(np.intersect1d(a, b)) * 100 >= 90 * len(np.union1d(a, b)) for b in sets] for a in sets]
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert not want[i][j] or label[i] == label[j]


# ------------------------------------------------------------------ 3 chat formatting

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_prefix_and_masks(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "x"), (3, 0, None, None), (3, 1, "assistant", "é"), (None, 0, "user", "lost")]
    pairs = chat_format.swapped_replies(spark.createDataFrame(rows, TURNS).withColumn("chosen", F.lit(1)))
    got = {r["id"]: r for r in chat_format.preference_format(pairs).collect()}
    assert sorted(got) == [0, 1, 3]
    r = got[0]
    assert (r["prompt_turns"], r["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert (r["chosen"], r["rejected"]) == ("<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n")
    s = r["chosen_spans"][0]
    assert r["chosen"][s["start"] : s["end"]] == "yes<|end|>"
    assert got[3]["prompt"] == "<|unknown|>\n<|end|>\n" and got[3]["rejected"] == "" and got[3]["chosen"].endswith("é<|end|>\n")
    same = spark.createDataFrame([(1, [("user", "a")], [("user", "a")])], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    r = chat_format.preference_format(same).first()
    assert (r["prompt_turns"], r["chosen"], r["rejected"]) == (1, "", "")
    assert chat_format.swapped_replies(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_keeps_other_columns_and_odd_rows(spark):
    """Clashing names, names with a dot, nulls, repeats, a very long text, an empty table."""
    turns = "array<struct<role:string,text:string>>"
    a, b = [("user", "q"), ("assistant", "x" * 300_000)], [("user", "q"), ("assistant", None)]
    rows = [(1, a, b, 7, "p", "dot"), (1, a, b, 7, "p", "dot"), (2, None, b, 8, None, None), (3, [], [], 9, "", "")]
    df = spark.createDataFrame(rows, f"id int, chosen {turns}, rejected {turns}, n int, prompt string, `a.b` string")
    df = df.withColumn("row", F.lit(1)).withColumn("prompt_turns", F.lit("clash")).withColumn("chosen_spans", F.lit(0))
    out = chat_format.preference_format(df)
    assert out.columns == ["id", "n", "a.b", "row", *chat_format.ADDED]
    got = sorted(out.collect(), key=lambda r: r["id"])
    assert [(r["id"], r["n"], r["prompt_turns"], r["prompt"]) for r in got] == [(1, 7, 1, "<|user|>\nq<|end|>\n")] * 2 + [(2, 8, 0, ""), (3, 9, 0, "")]
    s = got[0]["chosen_spans"][0]
    assert got[0]["chosen"][s["start"] : s["end"]] == "x" * 300_000 + "<|end|>" and got[2]["chosen"] == ""
    assert chat_format.preference_format(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 4 suffix dedup


@pytest.mark.parametrize(("width", "alphabet"), [(8, "ab"), (12, "abcé "), (50, "abcd ")])
def test_dedup_equals_brute_force(spark, width, alphabet):
    rng = random.Random(width)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(width // 2, 3 * width))) for _ in range(10)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(2 * width))) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    rows += [(90, rows[5][1]), (91, rows[5][1]), (92, None), (None, rows[7][1]), (3, rows[3][1]), (4, rows[9][1]), (93, ""), (94, passages[0] * 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(0)).withColumn("marks", F.lit(1)).withColumn("__id", F.lit("x"))
    for more in ({}, {"hot_docs": 3, "bucket_bytes": 300}):  # hot keys split by windows, several buckets a task
        got = suffix_dedup.remove_repeats(df, width=width, **more)
        assert got.columns == ["doc_id", "text", "marks", "__id", "kept", "n_bytes", "spans"]
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got.collect()) == brute.removed(rows, width)


def test_dedup_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeats(df).count() == 0
    one = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "é" * 60), (2, "x" + "é" * 60)], DOCS), width=50, as_text=True)
    assert {r["doc_id"]: r["kept"] for r in one.collect()} == {1: "é" * 60, 2: "x"}


def test_dedup_refuses_text_ids(spark):
    with pytest.raises(TypeError, match="integer"):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_dedup_query_columns(spark, tmp_path):
    """Every contract column of the registered query against brute force, with a very long text."""
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcdefgé ") for _ in range(70)) for _ in range(30)]
    rows = [(i, "".join(rng.choice(lines) if rng.random() < 0.3 else "".join(rng.choice("abcdefg ") for _ in range(60)) for _ in range(rng.randrange(8)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "".join("".join(rng.choice("abcdef ") for _ in range(90)) + rng.choice(lines) for _ in range(300)))]
    spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op4_suffix_array_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, n, sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute.removed(rows, 50)]
    assert sorted(map(tuple, got)) == want


def strings_of(rng, alphabet, n, longest):
    return [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_index_gives_matching_statistics(monkeypatch):
    """Lengths, smallest owners and marks of foreign strings, against looking everywhere."""
    rng = random.Random(3)
    steps = mismatches = 0
    for trial in range(120):
        alphabet, width = (b"ab", b"abcdefgh")[trial % 2], rng.choice([3, 5, 8])
        base = strings_of(rng, alphabet, rng.randint(1, 6), 40)

        def mutated(rate, base=base, alphabet=alphabet):
            return bytes(c if rng.random() > rate else rng.choice(alphabet) for c in rng.choice(base))

        strings = [*dict.fromkeys(mutated(0.05) for _ in range(rng.randint(1, 20)))]
        owner = np.array([rng.randint(0, 9) for _ in strings])
        index = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([*map(len, strings)]), owner, width)
        asked = strings_of(rng, alphabet + b"z", 4, 30) + [mutated(0.1) for _ in range(6)]
        data, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([*map(len, asked)])
        starts, got = ends - [*map(len, asked)], {}
        for _, at, row, place, length in index.stream(data, starts, ends):
            least = index.least_owner(row, place)
            for p, n, low in zip(at.tolist(), length.tolist(), least.tolist(), strict=True):
                got[p] = n
                if n >= width:
                    piece = data[p : p + width].tobytes()
                    assert low == min(o for o, x in zip(owner, strings, strict=True) if piece in x)
        for a, z in zip(starts, ends, strict=True):
            for p in range(a, z):
                assert got[p] == next(k for k in range(z - p, -1, -1) if not k or any(data[p : p + k].tobytes() in x for x in strings))
        steps, mismatches = steps + index.steps, mismatches + index.mismatches
        kept = [i for i, x in enumerate(strings) if len(x) >= width]
        strings, owner = [strings[i] for i in kept], owner[kept]
        if strings:
            monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", rng.choice([40, 200, 1 << 18]))
            monkeypatch.setattr(suffix_dedup, "STREAMS", rng.choice([2, 1 << 16]))
            ends = np.cumsum([*map(len, strings)])
            gone = suffix_dedup.earlier(np.frombuffer(b"".join(strings), np.uint8), ends, owner, np.ones(len(strings), int), width)
            for a, o, x in zip(ends - [*map(len, strings)], owner, strings, strict=True):
                for p in range(len(x) - width + 1):
                    assert gone[a + p] == any(q < o and x[p : p + width] in y for q, y in zip(owner, strings, strict=True))
    assert mismatches > steps / 10


def test_index_compresses_and_marks_by_other_strings():
    """On a repetitive corpus runs are far fewer than symbols, and marks come from streams with mismatches."""
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(3000))
    copies = [bytes(c if rng.random() > 0.002 else 120 for c in base) for _ in range(40)]
    index = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(copies), np.uint8), np.arange(1, 41) * 3000, np.arange(40), 50)
    assert len(index.head) < index.size / 10
    seen = []
    suffix_dedup.earlier(np.frombuffer(b"".join(copies), np.uint8), np.arange(1, 41) * 3000, np.arange(40), np.zeros(40, int), 50, seen.append)
    assert sum(i.mismatches for i in seen) > 0 and sum(i.steps for i in seen) > 100_000


def test_strings_with_bytes_of_their_own_are_not_indexed():
    """Every string that shares a window stays, and most of those that share their minimizer alone go."""
    rng = random.Random(8)
    width, anchor = 50, 20
    minimizer = bytes(rng.choice(b"abcdefgh") for _ in range(anchor))
    sides = [bytes(rng.choice(b"abcdefgh") for _ in range(30)) for _ in range(12)]
    strings = {}
    for _ in range(400):
        before, after = (rng.choice(sides) if rng.random() < 0.4 else bytes(rng.choice(b"abcdefgh") for _ in range(30)) for _ in "ab")
        a = rng.randint(0, 30)
        text = before[30 - a :] + minimizer + after[: rng.randint(30 - a, 30)]
        strings[text] = a
    texts, key = list(strings), np.array([rng.randint(0, 1) for _ in strings])
    ends = np.cumsum([*map(len, texts)])
    at = np.array([*strings.values()])
    may = suffix_dedup.alike(np.frombuffer(b"".join(texts), np.uint8), ends - [*map(len, texts)], ends, at, key, width, anchor)
    windows = [{x[p : p + width] for p in range(len(x) - width + 1)} for x in texts]
    share = [any(key[i] == key[j] and i != j and windows[i] & windows[j] for j in range(len(texts))) for i in range(len(texts))]
    assert all(may[i] for i in np.flatnonzero(share))
    assert 10 < sum(share) < sum(may) < len(texts) - 50
    assert suffix_dedup.alike(np.frombuffer(b"".join(texts), np.uint8), ends - [*map(len, texts)], ends, np.full(len(at), suffix_dedup.NOWHERE), key, width, anchor).all()


def test_marks_are_a_row_a_document(spark):
    """However many buckets and tasks a document's repeated passages lie in."""
    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(40)]
    rows = [(i, "".join(rng.sample(passages, 12)), []) for i in range(60)]
    source = spark.createDataFrame(rows, "id long, text string, none array<long>").repartition(4)
    shared = suffix_dedup.shared_keys(source, 50, 20, 4, 64, 1 << 14).groupBy("doc").agg(F.collect_list("key").alias("keys"))
    texts = source.join(shared.withColumnRenamed("doc", "id"), "id").select("id", "text", "keys")
    packed = suffix_dedup.segments(texts, 50, 20, 64, np.zeros(0, np.uint64))
    found = suffix_dedup.marks(packed, 50, 20, 4, 64).collect()
    assert len(found) == len({r["doc"] for r in found}) > 50


# ------------------------------------------------------------------ 5 top-k search


def test_search_equals_brute_force(spark):
    rows = [(i, t) for i, t in made(9, 260, 40)]
    df = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(0))
    asked = [i for i, t in rows if i % 20 == 0]
    for more in ({}, {"block_terms": 100}, {"block_queries": 5}):
        got = topk_search.search(df, df.filter("doc_id % 20 = 0"), k=7, **more)
        assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got.collect()) == brute.search(rows, asked, 7)
    assert topk_search.search(df.limit(0), df.limit(0)).count() == 0
    empty = spark.createDataFrame([(0, None), (1, "")], DOCS)
    assert topk_search.search(empty, empty).count() == 0


# ------------------------------------------------------------------ 6 mixing


def test_mixing_hits_its_rates_and_repeats(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").when(F.col("id") < 3900, "b").alias("source"), F.lit("x").alias("copy"))
    out = mixing.mix(df, weights={"a": 0.25, "b": 0.75}, total=2000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 500) < 100 and abs(n["b"] - 1500) < 150 and None not in n
    again = mixing.mix(df.repartition(7), weights={"a": 0.25, "b": 0.75}, total=2000)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    copies = Counter(r["doc_id"] for r in out.filter("source = 'b'").collect())
    zero = sum(copies[k] == 0 for k in range(3000, 3900)) / 900
    assert abs(zero - 2.718281828 ** (-1500 / 900)) < 0.05  # Poisson's share of none
    assert mixing.mix(df).filter("source is null").count() > 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_columns_and_repeated_rows(spark):
    rows = [(1, "a", 5, "x" * 200_000), (1, "a", 5, "x" * 200_000), (2, None, 6, None), (None, "b", 7, ""), (3, "b", 8, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int, text string").withColumn("rate", F.lit(1)).withColumn("order_key", F.lit("clash")).withColumn("a.b", F.lit(2))
    out = mixing.mix(df, total=400)
    assert out.columns == ["doc_id", "source", "n", "text", "rate", "a.b", "copy", "order_key"]
    got = Counter((r["doc_id"], r["source"], r["n"], r["copy"]) for r in out.collect())
    twice = {c: k for (d, _, _, c), k in got.items() if d == 1}
    assert set(twice.values()) == {2} and sorted(twice) == list(range(1, len(twice) + 1))


@pytest.mark.parametrize("rate", [0.3, 7.0, 150.0, 5000.0, 400_000.0])
def test_mixing_inverts_poisson(spark, rate):
    """Low count, cumulative probabilities and their look-up against sums of the distribution itself."""
    import math

    r = mixing.poisson_thresholds(spark.createDataFrame([("a", rate)], "source string, rate double")).first()
    total, k = 0.0, r["low"]
    assert k == 0 or math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) < 2**-60
    for c in r["steps"]:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert abs(c - total) < 1e-9
        k += 1
    assert abs(total - 1) < 1e-9
    u = [0.0, 0.1, 0.5, 0.9, 0.999999, *r["steps"][:3], r["steps"][-1]]
    rows = spark.createDataFrame([(x, r["low"], r["steps"]) for x in u], "u double, low long, steps array<double>")
    got = rows.select(mixing.copies(F.col("low"), F.col("steps"), F.col("u")).alias("n")).collect()
    assert [x["n"] for x in got] == [r["low"] + sum(c <= x for c in r["steps"]) for x in u]


def test_mixing_deals_out_large_counts(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)], "doc_id long, source string")
    out = mixing.mix(df, total=20_000)
    n = Counter(r["doc_id"] for r in out.collect())
    assert len(n) == 5 and all(3500 < x < 4500 for x in n.values())
    assert out.select("doc_id", "copy").distinct().count() == sum(n.values()) == out.count()
    assert out.agg(F.max("copy")).first()[0] == max(n.values())


# ------------------------------------------------------------------ 7 licences


def test_licences_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["MIT", "mit", "License", "license", "Apache", "General", "public", "gnu", "x", "é", "2", ".", "\n"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(800)] + [(900, None), (901, ""), (902, "MIT license"), (903, "license mit")]
    got = license_scan.scan(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))).collect()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licences(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    notice = "Licensed under CC BY-NC 4.0. All Rights Reserved"
    r = license_scan.scan(spark.createDataFrame([(1, notice)], DOCS)).first()
    assert (r["labels"], r["base_labels"], r["score"]) == ("cc-by-nc,proprietary", "", 1.0)
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append("zq" + str(rng.randrange(999)) if x < 2 * rate / 3 else w)
        if x > 1 - rate / 3:
            out.append("zi" + str(rng.randrange(999)))
    return out


FOLDER = "/usr/share/common-licenses"


def test_licences_survive_edits(spark):
    """Every whole text and notice with a twentieth of its words changed, inside other words, is found; little else is."""
    rng = random.Random(11)
    known = license_scan.templates(FOLDER)
    vocabulary = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "st", "re")] + ["the", "of", "and", "software", "license", "this", "any", "copy"]
    prose = lambda n: rng.choices(vocabulary, k=n)
    rows, truth = [], {}
    for t in known:
        if not t.together:
            for _ in range(2):
                i = len(rows)
                words = license_scan.words_of(t.text)
                rows.append((i, " ".join([*prose(rng.randrange(80)), *edited(rng, words, 0.05), *prose(rng.randrange(80))])))
                truth[i] = t.label
    clean = range(len(rows), len(rows) + 150)
    rows += [(i, " ".join(prose(300))) for i in clean]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, DOCS), known=known).collect()}
    caught = sum(truth[i] in got[i]["labels"].split(",") for i in truth)
    assert caught >= 0.97 * len(truth)
    base = lambda r: set(r["base_labels"].split(","))
    given = [(i, x) for i in got for x in got[i]["labels"].split(",") if x and x not in base(got[i])]
    right = sum(x == truth.get(i) for i, x in given)
    # whole licences quote others' names, so statements in them are labels too
    stated = sum(x != truth.get(i) and i in truth and any(m["label"] == x and m["words"] <= 8 for m in got[i]["matches"]) for i, x in given)
    assert right + stated >= 0.9 * len(given) and not any(got[i]["labels"] for i in clean)


def test_licence_labels_equal_brute_force(spark):
    """Labels against aligning every template with every text whole."""
    rng = random.Random(13)
    known = (*license_scan.templates()[:8], license_scan.Template("x", " ".join(f"w{k % 17}" for k in range(30))), license_scan.Template("y", " ".join(f"v{k % 23}" for k in range(40))))
    rows = []
    for i in range(60):
        words = [f"o{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        for t in rng.sample(known, rng.randrange(3)):
            words += edited(rng, license_scan.words_of(t.text), rng.choice([0, 0.05, 0.9])) + [f"o{rng.randrange(50)}" for _ in range(rng.randrange(9))]
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, DOCS), known=known).collect()}
    assert got == {i: brute.licence_labels(t, known) for i, t in rows}


def test_licence_query_columns(spark, tmp_path):
    rows = [(1, "x MIT License y mit license"), (2, None), (2, "General Public License"), (3, "word " * 60_000 + "apache license"), (4, "")]
    spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted([r["doc_id"], *(r[c] for c in columns)] for r in got) == sorted([i, *brute.licences(t)] for i, t in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


# ------------------------------------------------------------------ 8 urls


def test_url_rules(spark):
    rows = [(1, None), (2, ""), (3, "no"), (4, "HTTP://WWW.Example.COM/en/x?q#f"), (5, "a://net/es/"), (6, "a://xnet/es/"), (7, "x://b.net?/es/"), (8, "a://shop.example.com/en/?x"), (8, "a://shop.example.com/en/?x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("x", F.lit(1)).withColumn("host", F.lit("clash"))
    want = [(1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "www.example.com", "/en/x", "www.example.com/en/"), (5, "net", "/es/", "net/es/"), (6, "xnet", "/es/", None), (7, "b.net", "", None)]
    want += [(8, "shop.example.com", "/en/", "example.com/en/")] * 2
    for chain in (64, 0):
        url_filter.CHAIN = chain
        got = url_filter.judge(df, url_filter.RULES)
        assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule").collect()), key=str) == want
        assert {r["verdict"] for r in got.collect()} <= {"allow", "block"}
    url_filter.CHAIN = 64
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0


def test_url_reputation_by_pages_themselves(spark, tmp_path):
    """Two hosts of one suffix, and of one domain, get verdicts of their own from what their pages hold; null pages tell nothing."""
    fine, junk = "<p>" + "plain words here " * 10 + "</p>", "<p>" + "%%% *** ### ||| word " * 10 + "</p>"
    rows = [(i, f"x://good.net/{i}", fine) for i in range(30)] + [(100 + i, f"x://bad.net/{i}", junk) for i in range(30)]
    rows += [(200 + i, f"x://a.mixed.org/{i}", fine) for i in range(40)] + [(300 + i, f"x://b.mixed.org/{i}", "<b>short</b>") for i in range(40)]
    rows += [(400, "x://bad.net/null", None), (401, "x://new.bad.net/", None), (402, None, None), (403, "x://unseen.com/en/", junk), (404, "x://long.net/" + "y" * 200_000, fine)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bound", F.lit("clash"))
    assert {r["good"] for r in url_filter.page_outcomes(df).collect()} == {True, False} and url_filter.page_outcomes(df).count() == len(rows) - 3
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.QUERIES["op8_url_filter"](spark, str(tmp_path)).collect()}
    assert got[1] == got[201] == got[402] == got[403] == got[404] == "allow" and got[101] == got[301] == got[400] == got[401] == "block"


def test_url_reputation_shrinks(spark):
    good = [("a.big.com", True)] * 50 + [("b.big.com", False)] + [("c.bad.com", False)] * 40 + [("d.bad.com", False)] * 3
    outcomes = spark.createDataFrame(good, "host string, good boolean")
    host = {r["host"]: r["a"] / (r["a"] + r["b"]) for r in url_filter.host_posteriors(url_filter.host_counts(outcomes))[0].collect()}
    assert host["a.big.com"] > 0.9 and host["c.bad.com"] < 0.2
    assert host["b.big.com"] > host["d.bad.com"]  # one bad page on a good domain weighs less
    pages = spark.createDataFrame([(1, "x://c.bad.com/"), (2, "x://new.bad.com/"), (3, "x://a.big.com/"), (4, "x://never.seen/")], "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], outcomes).collect()}
    assert got[1] == "block" and got[3] == "allow" and got[4] == "allow"
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""), "my.co.info": ("co.info", "info")}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == hosts
    shared = spark.createDataFrame([("bad.co.uk", False)] * 40 + [(f"ok{k}.co.uk", True) for k in range(60)], "host string, good boolean")
    some = spark.createDataFrame([(1, "x://new.co.uk/"), (2, "x://more.bad.co.uk/")], "page_id int, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(some, [], shared).collect()}
    assert verdicts == {1: "allow", 2: "block"}


# ------------------------------------------------------------------ 9 quality rules


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(4)
    pieces = ["a", "b", "c", " ", "\n", "\t", "a b c", "#", "|", "É", "x\x1cy", "a b c\n", "!!"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(300)] + [(900, None), (901, ""), (902, " \n ")]
    got = quality_rules.measure(spark.createDataFrame(rows, DOCS).withColumn("m", F.lit(1)))
    for r in got.collect():
        assert tuple(r["m"])[:5] == brute.quality(r["text"])
    clash = spark.createDataFrame([(1, "a b c", 3, 4)], "doc_id long, text string, `__words` int, `__row` int").withColumn("__text", F.lit(5))
    kept = quality_rules.measure(clash)
    assert kept.columns == [*clash.columns, "m"] and tuple(kept.first())[2:5] == (3, 4, 5)


def test_quality_query_columns(spark, tmp_path):
    """Counts, base_failed and the learned verdict of the registered query, column by column."""
    rng = random.Random(21)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(rng.choice([20, 60, 90]))]
        if i % 5 == 0:
            words = [f"{w}##|" for w in words]
        if i % 7 == 0:
            words = words[:6] * 12
        rows.append((i, " ".join(words) + rng.choice(["", "\nsame\nsame"])))
    rows += [(300, None), (301, ""), (302, "w " * 100_000), (1, rows[1][1])]
    labels = [(i, 0 if i % 5 == 0 else 1) for i in range(240)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        n, *counts = brute.quality(text)
        want.append((i, n, *counts, n < 50 or 100 * counts[3] > 50 * n))
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(want)
    rules = quality_rules.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))
    texts = dict(rows)
    for r in got:
        fits = [all((brute.ratios(texts[r["doc_id"]])[c.feature] > c.threshold) == c.above for c in rule) for rule in rules.rules]
        assert r["kept"] == (not r["base_failed"] and not any(fits))


def test_rules_find_planted_junk(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
        bad = i % 6 == 0
        rows.append((i, " ".join(f"{w}###" for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (7, None), (9999, 0)], "doc_id long, quality int")
    rules = quality_rules.learn(docs, known)
    got = {r["doc_id"]: r["rule"] for r in quality_rules.judge(docs, rules).collect()}
    assert all((got[i] > 0) == (i % 6 == 0) for i in range(600)) and len(rules.rules) == 1
    assert quality_rules.learn(docs.limit(0), known.limit(0)).rules == []
    assert quality_rules.judge(docs.limit(0), rules).count() == 0


# ------------------------------------------------------------------ 10 toxicity


def test_toxicity_learns_words_and_locates_sentences(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        sentences = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(8)) for _ in range(6)]
        if i % 5 == 0:
            sentences[3] += " You MORON"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "...")], DOCS).withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (3, None), (5000, 1)], "doc_id long, toxic int").filter(toxicity.fold("doc_id") != 1))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= 0.7) == (i % 5 == 0) for i in range(500))
    assert all(0 <= got[i]["score"] < 0.1 for i in (1000, 1001, 1002))
    r = got[10]
    assert len(r["offending"]) == 1 and "moron" in r["text"][r["offending"][0]["start"] : r["offending"][0]["end"]].lower()
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.score(docs, none).filter("score < 0 or score > 1").count() == 0


def test_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.fold("id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)
