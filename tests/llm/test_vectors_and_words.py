"""Word pieces, vector codes and whitening, against the library and plain versions."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnwork.llm import vectorcode, whitening, wordpieces

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def odd_texts(n):
    rng = random.Random(12)
    letters = "aeinorst lmh'’.,!?-ÉéÀçßΣσİıǅ€😀👍日本語テキスト가나다 　́̈\x01\x1c\x1f\x85\xad ١٢３½ⅷ²ºµ_#%\n\t"
    extra = ["<|endoftext|>", "<|startoftext|>", "don't IT'S we'LL", "<|endoftext", "é", "가"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(letters if i % 2 else "aabbnost ") for _ in range(rng.randrange(40)))
        out.append(text + rng.choice(extra) if i % 5 == 0 else text)
    for _ in range(n // 4):
        out.append("".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(6)))
    return out


def test_word_pieces_are_the_library_s_on_odd_strings(library):
    own = wordpieces.WordTokens(WORDS)
    assert own.cuts
    for text in odd_texts(4000):
        assert own.encode(text) == expected(library, text), repr(text)
    own.cuts = False
    for text in odd_texts(400):
        assert own.encode(text) == expected(library, text), repr(text)


def test_every_token_is_encoded_as_itself_or_as_the_library_does(library):
    own = wordpieces.WordTokens(WORDS)
    for name in own.table.names[::7]:
        word = name.removesuffix("</w>")
        assert own.encode(word) == expected(library, word), word


def plain_merges(word, ranks, suffix):
    """The earliest merge, leftmost first, until none is left."""
    parts = [*word[:-1], word[-1] + suffix]
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_prefix_table_equals_plain_merging_on_trained_merges():
    rng = random.Random(3)
    for suffix in ("</w>", ""):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
        split = [[*w[:-1], w[-1] + suffix] for w in words]
        merges = []
        for _ in range(60):
            pairs = {}
            for parts in split:
                for p in zip(parts, parts[1:]):
                    pairs[p] = pairs.get(p, 0) + 1
            best = max(sorted(p for p in pairs if p[0] + p[1] not in {a + b for a, b in merges}), key=pairs.get)
            merges.append(best)
            split = [plain_merges(w, {p: i for i, p in enumerate(merges)}, suffix) for w in words]
        tokens = sorted({c for c in "abc"} | {c + suffix for c in "abc"} | {a + b for a, b in merges})
        table = wordpieces.PrefixTable({t: i for i, t in enumerate(tokens)}, merges, suffix)
        ranks = {p: i for i, p in enumerate(merges)}
        for _ in range(3000):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
            assert [table.names[t] for t in table.encode(word)] == plain_merges(word, ranks, suffix), word
    with pytest.raises(ValueError, match="twice"):
        wordpieces.PrefixTable({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("a", "aa"), ("aa", "a")], "")


def test_word_pieces_take_linear_time_and_bounded_memory(library, monkeypatch):
    own = wordpieces.WordTokens(WORDS)
    long = "ab" * 40_000
    assert own.encode(long) == expected(library, long)
    monkeypatch.setattr(wordpieces, "REMEMBERED", 100_000)
    monkeypatch.setattr(wordpieces, "PAIRS", 50)
    monkeypatch.setattr(wordpieces, "SLICE_BYTES", 1000)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000))
    assert own.encode(text) == expected(library, text)
    assert len(own.young) + len(own.old) < 1500 and len(own.table.young) + len(own.table.old) <= 100


def test_word_pieces_of_a_table(spark, library):
    texts = [None, "", "  \n", "　", "Hello, World! it's 42", "x" * 70_000, "naïve café " * 3000, "<|endoftext|>a<|startoftext|>", *odd_texts(60), "same", "same"]
    rows = [(i if i % 9 else None, t, "clash", b"clash") for i, t in enumerate(texts)] + [(3, "same", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, packed_ids binary").repartition(3)
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.packed_ids), r.decoded) for r in wordpieces.encode_words(docs, WORDS).collect())
    want = [(i or -1, *expected(library, t)) for i, t, *_ in rows]
    assert got == sorted((i, len(ids) // 4, ids, decoded) for i, ids, decoded in want)
    assert wordpieces.encode_words(docs.limit(0), WORDS).count() == 0


def test_word_pieces_refuse_other_tokenizers():
    with pytest.raises(ValueError):
        wordpieces.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_piece_query(spark, library, tmp_path):
    import __spark_entry__

    spark.createDataFrame([(1, "It's a Test"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["op12_wordpieces"](spark, str(tmp_path)).collect()}
    ids, decoded = expected(library, "It's a Test")
    assert got[1].n_tokens == len(ids) // 4 and got[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, component int"


def vectors(n, d, seed, spread=1.0):
    """Rows with repeated ids and vectors, null ids and labels, and ones that can't be used."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = []
    for i in range(n):
        v = (centres[i % 5] + spread * rng.normal(size=d)).astype("f4").tolist()
        rows.append((None if i % 17 == 3 else i // 2 if i % 7 == 0 else i, v, None if i % 11 == 0 else i % 3, "clash", i))
    rows += rows[5:9]
    bad = [None, [None] * d, [NAN] + [0.0] * (d - 1), [0.0] * (d - 1) + [INF], [-INF] * d, [None, NAN] + [0.0] * (d - 2)]
    return rows + [(10_000 + i, v, 0, None, None) for i, v in enumerate(bad)], rows


def plain_codes(rows, parts=4, size=256, rounds=4):
    """Every distance, in whole numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in rows], object).reshape(len(rows), parts, -1)
    books = x[:size].copy()

    def assign():
        out = []
        for v in x:
            far = [((books[:, p] - v[p]) ** 2).sum(axis=1) for p in range(parts)]
            out.append([min((d, e) for e, d in enumerate(f)) for f in far])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books)):
                mine = [v[p] for v, f in zip(x, found, strict=True) if f[p][1] == e]
                if mine:
                    books[e, p] = [int(s) // len(mine) for s in np.sum(mine, axis=0)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    told = sorted(((r[0], "".join(f"{e:02x}" for _, e in f), err, by_label[r[2]]) for r, f, err in zip(rows, found, errors, strict=True)), key=key)
    return told, books.transpose(1, 0, 2)


@pytest.mark.parametrize(("n", "size"), [(300, 256), (120, 16), (3, 256)])
def test_vector_codes_are_those_of_all_distances(spark, n, size):
    given, kept = vectors(n, 16, n)
    table = spark.createDataFrame(given, SCHEMA).repartition(3)
    codes, books = vectorcode.compress_vectors(table, size=size)
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    got = sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in codes.collect()), key=key)
    want, plain = plain_codes(kept, size=size)
    assert got == want
    assert books.tolist() == plain.tolist()


def test_vector_codes_of_ties_and_large_numbers():
    rng = np.random.default_rng(4)
    # Entries of one norm, repeated entries, zero, and numbers whose squares pass 53 and 64 bits.
    flat = np.array([[3, 4], [4, 3], [-3, -4], [0, 5], [3, 4], [0, 0]], object)
    for entries, parts in [(flat, rng.integers(-6, 7, (200, 2))), (flat * 10**9, rng.integers(-6, 7, (50, 2)) * 10**9), (flat * 10**14, rng.integers(-6, 7, (50, 2)) * 10**14)]:
        searched = vectorcode.Annuli(entries)
        index, far = searched.nearest(parts.astype(float))
        for row, i, d in zip(parts, index, far, strict=True):
            assert (d, i) == min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(entries))


def test_the_annulus_spares_comparisons():
    rng = np.random.default_rng(5)
    entries = (rng.normal(size=(256, 4)) * np.exp(2 * rng.normal(size=(256, 1))) * 1000).astype(int).astype(object)
    parts = np.floor(rng.normal(size=(500, 4)) * np.exp(2 * rng.normal(size=(500, 1))) * 1000)
    searched = vectorcode.Annuli(entries)
    searched.nearest(parts)
    assert searched.evaluated < 500 * 256 / 2


def test_vector_codes_of_nothing_and_what_they_decode_to(spark):
    none = spark.createDataFrame([(1, None, 1, None, None), (2, [NAN] * 4, 1, None, None)], SCHEMA)
    codes, books = vectorcode.compress_vectors(none)
    assert codes.count() == 0 and books.size == 0
    given, kept = vectors(60, 8, 9, spread=0.01)
    codes, books = vectorcode.compress_vectors(spark.createDataFrame(given, SCHEMA))
    errors = {(r.vec_id, bytes(r.code)): r.error for r in codes.collect()}
    assert len(kept) == codes.count()
    for r in vectorcode.decode_vectors(codes.filter("vec_id is not null"), books).collect():
        assert any(math.dist(r.embedding, v[1]) < 0.05 for v in kept if v[0] == r.vec_id)
    assert max(errors.values()) < 8 * 60**2
    with pytest.raises(ValueError, match="equal parts"):
        vectorcode.compress_vectors(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, None, None)], SCHEMA))


@pytest.mark.parametrize("shift", [100_000, 0])
def test_whitening_equals_plain_linear_algebra(spark, shift):
    given, kept = vectors(200, 12, 2)
    got = whitening.whiten(spark.createDataFrame(given, SCHEMA).repartition(3), shift=shift).collect()
    x = np.array([[math.floor(1024 * c) + shift for c in r[1]] for r in kept], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float)
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    projected = centred @ directions / np.sqrt(values)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
    for k in range(8):
        mine = sorted((r.deviation, abs(r.whitened)) for r in got if r.component == k + 1)
        want = sorted((int(((n * v - sums) ** 2).sum()), abs(w)) for v, w in zip(x, projected[:, k], strict=True))
        assert [a for a, _ in mine] == [a for a, _ in want]
        assert [b for _, b in mine] == pytest.approx([b for _, b in want], abs=1e-8)
        # One sign for all rows.
        by_id = {r.vec_id: r.whitened for r in got if r.component == k + 1 and r.vec_id is not None and r.vec_id > 150}
        signs = {np.sign(by_id[v[0]] * projected[i, k]) for i, v in enumerate(kept) if v[0] in by_id}
        assert len(signs) == 1


def test_whitening_of_nothing_of_equal_vectors_and_of_large_numbers(spark):
    none = spark.createDataFrame([(1, None, 1, None, None), (2, [NAN] * 4, 1, None, None)], SCHEMA)
    assert whitening.whiten(none).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1, None, None) for i in range(3)], SCHEMA)).collect()
    assert len(same) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}
    wide = [(i, [1e9 * i, -1e8 * i * i, 1.0 * i], 1, None, None) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(wide, SCHEMA)).collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in np.array(r[1], "f4").tolist()] for r in wide], object)
    for r in got:
        assert int(r.deviation) == int(((9 * x[r.vec_id] - x.sum(axis=0)) ** 2).sum())


def test_vector_queries_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__

    given, _ = vectors(90, 8, 6)
    spark.createDataFrame(given, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("op11_vectorcode", "vector_deviations"):
        frame = __spark_entry__.queries()[name](spark, str(tmp_path))
        told = con.execute(__spark_entry__.oracle_sql()[name])
        columns = [c[0] for c in told.description]
        key = lambda t: tuple((v is None, v if v is not None else 0) for v in t)
        assert sorted(map(tuple, frame.select(*columns).collect()), key=key) == sorted(told.fetchall(), key=key), name
    rows = __spark_entry__.queries()["op13_whitening"](spark, str(tmp_path))
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and rows.count() == 8 * 94
