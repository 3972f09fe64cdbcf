"""Each operator against a plain brute-force version, on small tables with nulls, ties and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import chat, decontam, exactdup, graph, html, pathjoin, piece, quality, sharding, tokenfile, urlfilter
from cairnwork.llm.words import shingle_sets, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, junk, a null and empty texts."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(3, 120)) for _ in range(60)]
    passage = sentence(rng, 60)
    texts = list(base)
    for t in base[:15]:
        texts += [t, t.replace(" ", "\t\n", 1)]
    for t in base[15:30]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [f"{sentence(rng, 40)} {passage}. {sentence(rng, 5)}" for _ in range(12)]
    texts += [None, "", "  ", "!!! ...", "One", "one!", "É È ü", "x " * 30, "a\x00b", "l" * 5000, sentence(rng, 8000)]
    return [(i, t, "en", "hot" if i % 3 else f"s{i % 7}", None) for i, t in enumerate(texts)]


def test_words_and_shingles(corpus):
    texts = [(t or "").encode() for _, t, *_ in corpus]
    found = words_of(texts)
    for d, (_, t, *_) in enumerate(corpus):
        assert found.text(found.first[d], found.first[d + 1]) == words(t)
    hashes = {}
    for (_, t, *_), tokens in zip(corpus, shingle_sets(found, 5), strict=True):
        w = words(t)
        k = min(5, len(w))
        plain = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        assert len(plain) == len(tokens)
        if len(plain) == 1:
            assert hashes.setdefault(next(iter(plain)), int(tokens[0])) == int(tokens[0])


def brute_decontam(docs, items, window=10):
    wins = {(i, tuple(w[a : a + s])) for i, t in items for w in [words(t)] if w for s in [min(window, len(w))] for a in range(len(w) - s + 1)}
    out = {}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for item, win in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    got.add(str(item))
        out[d] = (len(w), len(hit), sorted(got))
    return out


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_decontaminate(spark, block):
    rng = random.Random(3)
    items = [(i, sentence(rng, n, 60)) for i, n in enumerate([25, 10, 11, 4, 1, 30])] + [(6, None), (7, ""), (8, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (9, "Rare Words, here")]
    docs = [(i, sentence(rng, rng.randrange(0, 50), 60)) for i in range(20)]
    docs += [(100 + i, f"{sentence(rng, 7, 60)} {items[i % 6][1].upper()} {sentence(rng, 3, 60)}") for i in range(12)]
    docs += [(200, items[0][1]), (201, " ".join(items[5][1].split()[3:13])), (202, " ".join(items[5][1].split()[3:12])), (203, "w1 " * 40), (204, None), (205, ""), (206, "rare words-HERE")]
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block)
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out.collect()}
    expected = brute_decontam(docs, items)
    assert found == expected
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in out.collect())


def test_decontaminate_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontam.decontaminate(docs, items).collect()] == [(2, 0)]
    assert decontam.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert decontam.keep_clean(docs.withColumn("items", F.lit(1)), spark.createDataFrame([(1, "A, b")], "item_id long, text string")).count() == 0


def test_exact_dedup(spark, corpus):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in corpus}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    docs = table(spark, corpus).withColumn("keep_id", F.lit("clash"))
    rows = exactdup.exact_dedup(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert sorted(r.doc_id for r in exactdup.keep_first(docs).collect()) == sorted(min(g) for g in groups.values())
    assert exactdup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_tells_collisions_apart(spark, monkeypatch):
    monkeypatch.setattr(exactdup.F, "md5", lambda c: F.substring(F.sha2(c, 256), 1, 1))
    rows = [(i, f"text {i % 40}") for i in range(120)]
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exactdup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: (i % 40, 3) for i, _ in rows}


def brute_near(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = words(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    links = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (comp[i], len(links[i])) for i in ids}


@pytest.mark.parametrize("small,block", [(32, 1024), (2, 4)])
def test_near_classes(spark, corpus, small, block):
    docs = [(i, t) for i, t, *_ in corpus]
    out = pathjoin.near_classes(table(spark, corpus).withColumn("rep", F.lit(0)), small=small, block=block)
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == brute_near(docs)


def test_near_classes_large_group(spark):
    rng = random.Random(9)
    base = sentence(rng, 150).split()
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, sentence(rng, 100)) for i in range(40)]
    out = {r.doc_id: (r.class_id, r.n_links) for r in pathjoin.near_classes(spark.createDataFrame(docs, "doc_id long, text string"), block=64).collect()}
    expected = brute_near(docs)
    assert {i: c for i, (c, _) in out.items()} == {i: c for i, (c, _) in expected.items()}
    assert sum(n for _, n in out.values()) >= 0.995 * sum(n for _, n in expected.values())
    assert all(out[i][1] <= expected[i][1] for i in out)


def test_near_classes_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, pathjoin.near_classes(docs).collect()), key=str) == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (5, 5, 0), (None, None, 0)], key=str)
    assert pathjoin.near_classes(docs.limit(0)).count() == 0
    kept = [(r.doc_id, r.text) for r in pathjoin.keep_one(docs.unionByName(docs.sparkSession.createDataFrame([(5, "q r s t u"), (None, "x y z x y z"), (None, "X y z x y z"), (None, "")], docs.schema))).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f"), (5, None), (None, None), (5, "q r s t u"), (None, "x y z x y z"), (None, "")], key=str) or sorted(kept, key=str) == sorted([(1, "a b c d e f"), (5, None), (None, None), (5, "q r s t u"), (None, "X y z x y z"), (None, "")], key=str)


def test_runs_reach_the_recall_that_they_promise():
    """The bound against draws of whole trees: pairs with a token in common at each coordinate with probability 0.8."""
    assert pathjoin.recall_of(0.8, pathjoin.runs_for(0.8, 0.9997)) >= 0.9997
    rng = np.random.default_rng(6)
    runs, depth, trials = 1, 4, 4000

    def together(equal, left):
        if not left:
            return True
        a, b = rng.choice(pathjoin.COORDS, 2, replace=False)
        return any(equal[i] and together(equal, left - 1) for i in (a, b))

    met = sum(any(together(equal, depth) for _ in range(runs)) for equal in rng.random((trials, pathjoin.COORDS)) < 0.8)
    assert abs(met / trials - pathjoin.recall_of(0.8, runs, depth)) < 0.012


def test_recall_at_the_threshold(spark):
    """2,000 pairs of similarity 0.8 to 0.82, most of which must be found."""
    rng = random.Random(21)
    docs = []
    for i in range(2000):
        w = [f"u{rng.randrange(10**9)}" for _ in range(104)]
        v = list(w)
        for at in rng.sample(range(8, 96), 2):
            v[at] = f"x{rng.randrange(10**9)}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    out = {r.doc_id: r.class_id for r in pathjoin.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near = [(a, b) for a, b in zip(range(0, 4000, 2), range(1, 4000, 2), strict=True) for x, y in [({tuple(docs[j][1].split()[p : p + 5]) for p in range(100)} for j in (a, b))] if len(x & y) >= 0.8 * len(x | y)]
    assert len(near) >= 1500 and sum(out[a] == out[b] for a, b in near) >= 0.9985 * len(near)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_interleave(spark, corpus):
    rows = corpus * 3 + [(None, "t", None, None, None), (10**6, "t", None, "lone", 1)]
    out = sharding.interleave(table(spark, rows), shards=8).collect()
    assert len(out) == len(rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    counts = [len(shards[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    # A cut lies within half a row of each source's own cut, and so the place of a row within half a row for each source.
    sources = Counter(r[3] for r in rows)
    for source, n in sources.items():
        each = [sum(r.source == source for r in shards[s]) for s in range(8)]
        assert all(abs(x - n / 8) <= 1 + len(sources) * n / len(rows) for x in each), (source, n, each)
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)
    again = sharding.interleave(table(spark, rows[::-1]).repartition(3), shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert sharding.interleave(table(spark, rows).limit(0)).count() == 0


def test_interleave_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    out = sharding.interleave(table(spark, [(i, "t", "en", f"s{min(i % 9, 3)}", 1) for i in range(500)]), shards=7).collect()
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(7) for i in range(counts[s])]


def test_token_files(spark, corpus, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    odd = ["don't  stop\t\tit's\n\n\nnow ", " lead", "trail  ", "a\u00a0 b\u2003\u2003c", "x\x1c y\x1f\x1fz", "<|endoftext|> a<|endoftext|>", "𝛼𝛽 1234 ½", "\r\n \r\n"]
    rows = corpus + [(900 + i, t, "en", "s", 1) for i, t in enumerate(odd)]
    tokenfile.write_tokens(table(spark, rows), str(tmp_path / "t"), path, end_id=2, row_group_bytes=1 << 16, page_rows=8)
    out = tokenfile.read_tokens(spark, str(tmp_path / "t")).withColumn("crc", tokenfile.ids_crc32("ids")).orderBy("doc_id").collect()
    start = 0
    for (i, t, *_), r in zip(sorted(rows, key=lambda x: x[0]), out, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r["ids"]) == (i, start, len(ids), ids), t
        assert r.crc == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)
    seen, ids_seen = set(), []
    for file in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.ParquetFile(file)
        ids_seen += meta.read(["doc_id"]).column(0).to_pylist()
        for g in range(meta.metadata.num_row_groups):
            for c in range(meta.metadata.num_columns):
                column = meta.metadata.row_group(g).column(c)
                assert column.has_offset_index and (column.has_column_index or "ids" in column.path_in_schema)
                seen.add((column.path_in_schema.split(".")[0], *(e for e in column.encodings if "DICT" in e or "DELTA" in e)))
    assert ids_seen == sorted(ids_seen)
    assert ("ids", "RLE_DICTIONARY") in seen and ("doc_id", "DELTA_BINARY_PACKED") in seen


def test_token_reads_of_some_ids_leave_row_groups_alone(spark, tmp_path):
    import pyarrow.parquet as pq

    path, rng = str(tmp_path / "t"), random.Random(8)
    docs = spark.createDataFrame([(i, sentence(rng, 200, 10**6), 1) for i in range(4000)], "doc_id long, text string, shard int")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, files=2, row_group_bytes=1 << 18, page_rows=64)
    groups = [(g.column(0).statistics.min, g.column(0).statistics.max, g.num_rows) for f in (tmp_path / "t").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) > 4
    whole = {r.doc_id: (r.start, r.n_tokens, r["ids"]) for r in tokenfile.read_tokens(spark, path).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        some = tokenfile.read_tokens(spark, path, 1000, 1049)
        assert {r.doc_id: (r.start, r.n_tokens, r["ids"]) for r in some.collect()} == {i: whole[i] for i in range(1000, 1050)}
        leaves = some._jdf.queryExecution().executedPlan().collectLeaves()
        read = max(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 50 <= read <= sum(n for low, high, n in groups if low <= 1049 and high >= 1000) < 4000


def test_token_cutting_on_random_strings():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(31)
    lib, own = Tokenizer.from_file(path), tokenfile.ByteTokens(path)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u2003", "\u3000", "\x1c", "\x85", "a", "Word", "'s", "'ll", "don't", "1234", "½", "é", "ß", "ñandú", "日本語", "🙂", "e\u0301", "!!", ".", "_", "<|endoftext|>", "<|", "\u200b", "ℵ", "Ω", "-", "/", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 20_000)
    own, rng = tokenfile.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(30):
        own.encode(sentence(rng, 100, 10**9) + " " + "語" * 5000)
        assert max(map(len, own.young), default=0) <= tokenfile.LONGEST and own.held < 20_000 + 100 * 300


def test_token_ids_are_those_of_the_unchanged_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from cairnwork.llm import queries

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b", " x<|endoftext|><|endoftext|>\n\ny ", "it<|endoftext|>'s <|endoftext| > no", "<|endoftext", "", None, "plain text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert 50256 in lib.encode(texts[0], add_special_tokens=False).ids
    start = 0
    for r, t in zip(queries.op4_tokenfile(spark, str(tmp_path)).orderBy("doc_id").collect(), texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())), t
        start += len(ids)


def test_pieces(spark, corpus):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t, lang) for i, t, lang, *_ in corpus] + [(900, "  two  spaces ", "x"), (901, "emoji 🙂 and ▁mark", None), (902, "tab\tline\nend", "y"), (903, "日本語", "ja"), (904, "<s> </s>", "x")]
    out = piece.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("extra", F.lit(1)), path).collect()
    assert len(out) == len(rows) and {"extra", "ids", "starts", "ends", "decoded"} <= set(out[0].asDict())
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        text = texts[r.doc_id]
        raw = text.encode()
        assert r["ids"] == lib.encode(text, add_eos=True) and r.decoded == lib.decode(r["ids"])
        at = 0
        for i, a, b in zip(r["ids"][:-1], r.starts, r.ends, strict=False):
            assert a == at
            at = b
            if lib.is_byte(i):
                assert raw[a:b] == bytes([int(lib.id_to_piece(i)[3:5], 16)])
            else:
                assert raw[a:b].decode().replace(" ", "▁") in (lib.id_to_piece(i), lib.id_to_piece(i).removeprefix("▁") if a == 0 else None)
        assert at == len(raw) and r.ends[-1] == len(raw)
    back = piece.decode_pieces(spark.createDataFrame([(1, lib.encode("a b")), (2, None)], "k long, ids array<int>"), path)
    assert {r.k: r.decoded for r in back.collect()} == {1: "a b", 2: ""}


def test_pieces_raise_where_spans_cannot_follow(monkeypatch):
    own = piece.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    ids = np.asarray(own.lib.encode("two words"))
    assert own.spans(b"two words", ids)[1][-1] == 9
    with pytest.raises(ValueError):
        own.spans(b"two other words", ids)


def test_piece_normaliser_follows_the_character_map():
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(rule.serialized_model_proto())
    own = object.__new__(piece.Encoder)
    own.spec, own.chars = spec.normalizer_spec, piece.CharMap(spec.normalizer_spec.precompiled_charsmap)
    for text in ["ﬁ  ①", "Ａｂｃ\u3000ｄ", "e\u0301 ｶﾞ x²", " a\tb\u00ad ", "plain", "½ ﷺ", "가각"]:
        expected, _ = rule.Normalize(text, with_offsets=True)
        got, origin = own.normalise(text.encode())
        assert got.decode() == expected
        assert len(origin) == len(got) + 1 and (np.diff(origin) >= 0).all() and origin[-1] == len(text.encode())
    assert own.normalise(b"")[0] == b""


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></ul></nav><!-- c --><div class="ad">Buy</div><div>{site}</div><article><h1>Title {n} &amp; more</h1><p><b>First   para {n} of an article that goes on for a while<br>still<p>Second &eacute;&#233;
line</p><div class="comments"><p>Nice!</p></div><aside>x</aside><form><p>f</p></form>{inner}<p>Shared end.</p></article><footer>&copy; x</footer></body>"""


def test_extract(spark):
    inner = "<section><p>Follow our paper every day.</p></section>"
    rows = [(i, f"https://A.example/{i}", PAGE.format(n=i, site="Best site", inner=inner if i < 8 else "")) for i in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://b.example/", "<p>One<p>two<div>three &lt;b&gt;</div>four<script>no"), (23, "http://b.example/", "plain & simple <b"), (24, "http://b.example/", "<body><nav>m</nav><main><ul><li>a<li>b</ul></main>tail")]
    out = {r.page_id: r for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for i in range(12):
        assert out[i].text == f"Title {i} & more\nFirst para {i} of an article that goes on for a while still\nSecond éé line\nShared end.", out[i].text
        assert out[i].n_chars == len(out[i].text)
    assert [out[i].text for i in (20, 21, 22, 23, 24)] == ["", "", "One\ntwo\nthree <b>\nfour", "plain & simple", "a\nb"]
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extract_keeps_copied_articles(spark):
    page = "<body><div class='x'>S</div><article><h1>Same</h1><div><p>Copied text of the article.</p></div></article></body>"
    rows = [(i, "https://a.example/", page) for i in range(30)]
    assert {r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same\nCopied text of the article."}


def extracted(spark, pages, url="https://c.example/"):
    rows = [(i, url, p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("words", [200, 3])
def test_extract_finds_the_template_of_pages_without_a_main_element(spark, words):
    rng = random.Random(words)
    bodies = [f"Page {i} {sentence(rng, words)}" for i in range(8)]
    page = "<body><div class='x'><ul><li>Start<li>Products<li>Service</ul></div><div><div><p>{}</p></div></div><div class='y'>All rights are with the site</div></body>"
    assert extracted(spark, [page.format(b) for b in bodies]) == dict(enumerate(bodies))
    # Copies of a page are one page, and what recurs on fewer than five is its own.
    few = {i: f"Start\nProducts\nService\n{bodies[i % 4]}\nAll rights are with the site" for i in range(40)}
    assert extracted(spark, [page.format(bodies[i % 4]) for i in range(40)]) == few


def test_extract_counts_equal_brute_force(spark):
    """Subtrees that recur, counted plainly from a nested form of each page, and what goes with them when the count alone decides."""
    rng = random.Random(17)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Shared line one.", "Shared line two.", f"Own {rng.randrange(10**6)}."])
        return [rng.choice(["div", "p", "ul", "section"]) if depth > 1 else "p", *(tree(depth - 1) for _ in range(rng.randrange(1, 4)))]

    def wrap(t):
        return t if isinstance(t, str) else ["div", *(wrap(x) if not isinstance(x, str) else ["div", x] for x in t[1:])]

    pages = [["body", *(wrap(tree(3)) if not isinstance(x, str) else ["div", x] for x in (tree(3) for _ in range(4)))] for _ in range(30)]
    pages = [["body", *(x if not isinstance(x, str) else ["div", x] for x in p[1:])] for p in pages]
    shown = lambda t: t if isinstance(t, str) else f"<{t[0]}>{''.join(map(shown, t[1:]))}</{t[0]}>"
    inner = lambda t: [t] if not isinstance(t, str) else []
    texts = lambda t: [t] if isinstance(t, str) else [y for x in t[1:] for y in texts(x)]
    below = lambda t: [] if isinstance(t, str) else [repr(t)] * (t[0] != "body") + [y for x in t[1:] for y in below(x)]
    seen = defaultdict(set)
    for p in pages:
        for sub in below(p):
            seen[sub].add(tuple(texts(p)))
    template = {s for s, articles in seen.items() if len(articles) >= 5}
    left = lambda t: [t] if isinstance(t, str) else [] if repr(t) in template else [y for x in t[1:] for y in left(x)]
    rows = [(i, "https://d.example/", shown(p)) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "page": F.lit(0), "template": F.lit("t")})
    out = {r.page_id: r for r in html.extract_text(frame, markup=False).collect()}
    changed = 0
    for i, p in enumerate(pages):
        expected = left(p)
        if expected:
            assert out[i].text == "\n".join(expected)
            changed += expected != texts(p)
        assert out[i].n_template == len({s for s in below(p) if s in template})
    assert len(template) >= 2 and changed >= 10 and inner


def test_extract_is_linear_in_nesting_and_quotes():
    import time

    for source in ("<div>a" * 8000, '<a "' * 8000, "<a '>" * 8000, "<i>a" * 8000 + "</b>" * 8000, "<div class='menu'>a" * 8000, "<li><i>a" * 8000, "<center><p>x" * 8000):
        began = time.perf_counter()
        page = html.Page(source)
        page.subtrees()
        page.compact()
        assert time.perf_counter() - began < 3


def test_extract_keeps_article_text_with_such_names():
    page = "<body><article><h1>T</h1><section class='related-work'><p>Earlier work did this.</p></section><p id='share'>The share of it grew.</p><div class='comment-list'><p>Nice!</p></div><span class='ad'>Buy</span><div class='cookie-notice'>Cookies!</div></article></body>"
    assert html.main_text(page) == ["T", "Earlier work did this.", "The share of it grew."]


def test_extract_counts_decide_without_markup(spark):
    page = "<body><nav><ul><li>Home<li>News</ul></nav><div class='ad'>Buy now</div><article><h1>Head {0}</h1><p>Text {0}.</p></article><footer>All rights</footer></body>"
    pages = [(i, "https://e.example/", page.format(i)) for i in range(6)] + [(9, "https://f.example/", page.format(9))]
    out = {r.page_id: r for r in html.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string"), markup=False).collect()}
    assert all(out[i].text == f"Head {i}\nText {i}." for i in range(6)) and out[9].text.startswith("Home\nNews\nBuy now") and out[0].n_template == 6


def test_extract_finds_a_large_template_in_short_articles(spark):
    page = "<body><main><h1>Photo {}</h1><div><p>Follow us on every channel there is, each and every day.</p></div></main></body>"
    assert extracted(spark, [page.format(i) for i in range(7)]) == {i: f"Photo {i}" for i in range(7)}


def test_extract_leaves_no_page_bare(spark):
    page = "<body><div class='x'>Site</div><div><p>A long text that stands on many pages of this host.</p></div><div>Day {}</div></body>"
    pages = [page.format(i) for i in range(6)] + [page.replace("<div>Day {}</div>", "")]
    assert extracted(spark, pages) == {i: f"Day {i}" for i in range(6)} | {6: "A long text that stands on many pages of this host."}


BODY = "<h1>Head</h1><p>A text that goes on for quite a while.</p>"


@pytest.mark.parametrize("begin,end", [("<form id='aspnetForm'>", "</form>"), ("<div class='with-sidebar'>", "</div>"), ("<div class='layout has-menu'>", "</div>"), ("<div id='page-widget'>", "</div>"), ("<form><div class='with-sidebar'>", "</div></form>")])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>", "<div>{}</div>"])
def test_extract_keeps_a_wrapped_page(begin, end, inner):
    beside = "<nav>Menu</nav><div class='widget'>Tip</div><form><p>Search</p></form><div class='comments'>A long comment, it is longer than all of the text of the page itself.</div>"
    for source in (f"<body>{begin}{beside}{inner.format(BODY)}{end}</body>", f"<body>{begin}{inner.format(BODY + '<form>Send</form>')}{end}<footer>f</footer></body>", f"<body>{beside}{begin}{inner.format(BODY)}{end}</body>"):
        assert html.main_text(source) == ["Head", "A text that goes on for quite a while."], source


def test_extract_still_drops_what_wraps_no_page():
    beside = "<div class='widget'><article>Teaser one</article><article>Teaser two</article></div><form><p>Name and mail</p></form><div class='menu'>Start</div>"
    for source in (f"<body><article>{BODY}</article>{beside}</body>", f"<body><div>{BODY}</div>{beside}</body>", f"<body><main>{BODY}{beside}<div class='comments'><article>{'Talk. ' * 99}</article></div></main></body>"):
        assert html.main_text(source) == ["Head", "A text that goes on for quite a while."], source


def test_url_filter(spark):
    urls = ["https://WWW.Example.NET/en/1?x#y", "http://example.net/de/", "https://a.example.com/de/2", "https://b.org/fr", "https://b.org/fr/", "net", "http://net/", "http://notexample.net/en/", "ftp://casino-win.example.org/en/5", None, "", "https://www.gardens.example.org/en/5", "http://h?q=/en/", "x://y://z/p", "http://h.net?to=http://i.net/en/", "a\nb://C\n/d\n?e"]
    rows = list(enumerate(urls))
    out = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.labelled_urls(spark)).collect()}
    assert len(out) == len(rows)
    for i, u in rows:
        rest = (u or "").partition("://")[2]
        host = re.split(r"[/?#]", rest)[0].translate(LOWER)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(r), v == "block", r, v) for v, r in urlfilter.RULES for rh, _, rp in [r.partition("/")] if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp)]
        best = max(fits) if fits else (0, False, None, None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best[2]), u
        assert out[i].verdict == (best[3] or ("block" if out[i].chance >= 0.5 else "allow"))
    assert out[8].verdict == "block" and out[11].verdict == "allow"
    assert set(urlfilter.train(urlfilter.labelled_urls(spark).limit(0))) == {0.0}


def test_url_model_judges_hosts_that_it_has_not_seen(spark):
    rows, right = urlfilter.LABELLED, 0
    hosts = [re.split("[/.]", u.split("://")[1].removeprefix("www.").removeprefix("m.").removeprefix("blog."))[0] for u, _ in rows]
    assert len(set(hosts)) == len(rows)
    for part in range(3):
        taught = spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 != part], "url string, label int")
        asked = {i: y for i, (_, y) in enumerate(rows) if i % 3 == part}
        pages = spark.createDataFrame([(i, rows[i][0]) for i in asked], "page_id int, url string").withColumns({"host": F.lit("x"), "cells": F.lit(1), "fit": F.lit(2)})
        right += sum((r.verdict == "block") == (asked[r.page_id] == 1) for r in urlfilter.filter_urls(pages, taught, rules=[]).collect())
    assert right >= 0.85 * len(rows), right
    with pytest.raises(ValueError):
        urlfilter.train(urlfilter.labelled_urls(spark), most=10)


def test_url_training_equals_plain_logistic_regression(spark):
    labelled = urlfilter.labelled_urls(spark)
    weights = urlfilter.train(labelled, steps=40)
    rows = labelled.select("url", "label", urlfilter.cells(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).alias("c")).collect()
    x = np.zeros((len(rows), urlfilter.DIM + 1))
    for i, r in enumerate(rows):
        x[i, : urlfilter.DIM] = np.bincount(r.c, minlength=urlfilter.DIM) / len(r.c) ** 0.5
        x[i, -1] = 1
    y, w = np.array([r.label for r in rows], float), np.zeros(urlfilter.DIM + 1)
    for _ in range(40):
        w = w * (1 - 2.0 * 0.001) + 2.0 / len(rows) * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    assert np.abs(w - np.array(weights)).max() < 1e-6


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: ". ".join(" ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(4, 14))).capitalize() for _ in range(rng.randrange(5, 30))) + "."
    bad = [lambda: good().upper().replace(" ", "!! "), lambda: " | ".join(good().split()), lambda: " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in good().split()), lambda: " ".join(w for w in good().split()[:20] for _ in range(15))]
    docs, labels = [], []
    for i in range(600):
        junk = i % 4 == 0
        docs.append((i, bad[i // 4 % 4]() if junk else good()))
        labels.append((i, 0 if junk else 1))
    docs += [(2000, None), (2001, ""), (2002, "word"), (None, good())]
    labels += [(None, 1), (2000, None)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score_quality(frame, marks).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in quality.keep_good(frame, marks).collect()}
    assert {r.doc_id for r in out if r.predicted} == kept
    assert {r.score for r in quality.score_quality(frame, marks.limit(0)).collect()} == {0.5}
    assert quality.score_quality(frame.limit(0), marks).count() == 0


MAIL = {
    0: "Shall we meet on Monday? The room is free all day.\nI would bring the draft.",
    1: "> Shall we meet on Monday? The room is free\n> all day.\nYes, Monday is good for me.",
    2: "On Tuesday, Kim wrote:\n>> Shall we meet on Monday? The room is free all day.\n> Yes, Monday is good for me.\n\nThen I book the room.",
    3: "> I would bring the draft.\nPlease send the draft before Sunday evening.",
    4: "Nothing quoted here, only an answer.",
    5: "> Then I book the room.\nThank you very much.",
}


def test_parse_message():
    own, sentences, quotes = chat.parse_message(MAIL[2])
    assert own == "Then I book the room." and len(sentences) == 1 and [level for level, _ in quotes] == [2, 2, 1]
    assert chat.parse_message("plain\n\n\n\ntext") == ("plain\n\n\n\ntext", chat.parse_message("plain\n\n\n\ntext")[1], [])


@pytest.mark.parametrize("block", [1024, 2])
def test_chat(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [(7, t, "user", m) for t, m in MAIL.items()] + [(8, 0, None, "Hello there friend."), (8, 0, None, "Hello there friend."), (8, 3, "a", None), (8, 5, "a", "> nobody said this before\nok"), (None, 1, "user", "x y")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))).collect()
    mail = {r.turn: r for r in out if r.conv_id == 7}
    assert {t: (r.parent_turn, r.linked) for t, r in mail.items()} == {0: (None, False), 1: (0, True), 2: (1, True), 3: (0, True), 4: (3, False), 5: (2, True)}
    assert [r.turn for r in sorted(mail.values(), key=lambda r: r.position)] == [0, 1, 2, 5, 3, 4]
    assert mail[1].text == "Yes, Monday is good for me." and mail[2].text == "Then I book the room."
    other = sorted((r for r in out if r.conv_id == 8), key=lambda r: r.position)
    assert [list(map(tuple, mail[t].origins)) for t in (1, 2, 4)] == [[(1, 0, 2)], [(1, 1, 1), (2, 0, 2)], []]
    parts = {(r.conv_id, r.part): r.text for r in chat.conversations(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), most=4).collect()}
    assert set(parts) == {(7, 0), (7, 1), (8, 0), (None, 0)} and parts[(7, 0)] + parts[(7, 1)] == "".join(mail[t].chat for t in (0, 1, 2, 5, 3, 4))
    assert [(r.turn, r.parent_turn, r.n_rows, r.text) for r in other] == [(0, None, 2, "Hello there friend."), (3, 0, 1, ""), (5, 3, 1, "ok")]
    assert other[0].chat == "<|unknown|>\nHello there friend.\n<|end|>\n"
    assert [r.text for r in out if r.conv_id is None] == ["x y"]


@pytest.mark.parametrize("block", [1024, 3])
def test_chat_parent_has_most_of_the_quoted_sentences(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(12)
    said = {0: ["Good day all.", "Kind regards, Kim.", "The plan is ready."], 1: ["Yes."], 2: ["Good day all.", "Kind regards, Kim."]}
    asked = {3: said[0], 4: ["Yes."]}
    stock = [f"Common phrase {i}." for i in range(6)] + ["No."]
    for t in range(5, 60):
        said[t] = [*rng.sample(stock, rng.randrange(1, 5)), f"Own {t}."]
        asked[t] = [x for q in rng.choices(range(t), k=2) for x in said.get(q, []) if rng.random() < 0.7]
    rows = [(1, t, "u", "".join(f"> {x}\n" for x in asked.get(t, [])) + " ".join(said.get(t, [f"Answer {t}."]))) for t in range(60)]
    expected = {}
    for t in range(60):
        votes = {q: sum(x in said.get(q, []) for x in asked.get(t, [])) for q in range(t)}
        best = max(votes, key=lambda q: (votes[q], q), default=None)
        expected[t] = (best, True) if votes and votes[best] else (t - 1 if t else None, False)
    assert expected[3] == (0, True) and expected[4] == (1, True)
    out = chat.link_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.parent and r.parent.turn, r.linked) for r in out} == expected


def test_chat_long_thread_and_empty(spark):
    rng = random.Random(4)
    rows, parent = [], {}
    said = {}
    for t in range(80):
        p = rng.randrange(t) if t else None
        said[t] = f"Unique remark number {t} of this thread."
        rows.append((1, t, "u", (f"> {said[p]}\n" if p is not None else "") + said[t]))
        parent[t] = p
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent_turn for r in out} == parent
    order, todo = [], [0]
    while todo:
        x = todo.pop(0)
        order.append(x)
        todo = [t for t in sorted(parent) if parent[t] == x] + todo
    assert [r.turn for r in sorted(out, key=lambda r: r.position)] == order
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rows_with_repeated_and_null_ids_are_judged_one_by_one(spark):
    docs = spark.createDataFrame([(1, "some bad words here"), (1, "fine"), (1, "fine"), (None, "bad words"), (None, "fine text"), (None, None), (5, "ok")], "doc_id long, text string")
    items = spark.createDataFrame([(3, "bad words")], "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.decontaminate(docs, items).select("doc_id", "n_words", "n_hit").collect()), key=str)
    assert got == sorted([(1, 4, 2), (1, 1, 0), (1, 1, 0), (None, 2, 2), (None, 2, 0), (None, 0, 0), (5, 1, 0)], key=str)
    kept = sorted((tuple(r) for r in decontam.keep_clean(docs.withColumn("body", F.lit(1)).withColumn("doc", F.lit(2)), items).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(1, "fine"), (1, "fine"), (None, "fine text"), (None, None), (5, "ok")], key=str)


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup_keeps_one_row_of_each_text(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(exactdup.F, "md5", lambda c: F.substring(F.sha2(c, 256), 1, 1))
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (7, "z"), (7, "z"), (None, "a"), (None, "n"), (None, "n"), (9, None), (8, "")]
    rows += [(100 + i, f"t{i}") for i in range(20 if collide else 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__n", F.lit(1)).withColumn("keep_id", F.lit(0))
    expected = [(1, "a"), (2, "b"), (7, "z"), (None, "n"), (8, "")] + rows[11:]
    got = [(r.doc_id, r.text) for r in exactdup.keep_first(docs.drop("__n")).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    out = exactdup.exact_dedup(docs).collect()
    assert len(out) == len(rows) and sorted((r.doc_id for r in out if r.kept), key=str) == sorted((i for i, _ in expected), key=str)


def test_queries_equal_their_sql_with_repeated_ids(spark, tmp_path):
    import duckdb

    from cairnwork.llm import queries

    rows = [(1, "rare words here and there"), (1, "nothing"), (1, "nothing"), (2, "  nothing"), (None, "rare WORDS here"), (None, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, "words here"), (5, "rare words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("op1_decontaminate", "op7_exactdup"):
        found = queries.QUERIES[name](spark, str(tmp_path))
        theirs = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in theirs.description]
        assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, theirs.fetchall())), name


@pytest.mark.parametrize("name", ["quoted_threads", "url_rules", "shard_slots", "op1_decontaminate", "op7_exactdup"])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    from cairnwork.llm import queries

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found, theirs = queries.QUERIES[name](spark, data), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, theirs.fetchall()))


def test_chat_links_quotes_of_one_word_and_of_deeper_levels_alone(spark):
    rows = [(1, 0, "u", "Yes."), (1, 1, "u", "No."), (1, 2, "u", "Maybe so."), (1, 3, "u", ">> Yes.\nwell"), (1, 4, "u", "> No.\n>> Maybe so.\nfine"), (1, None, "u", "Before all.")]
    out = {r.turn: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (r.parent_turn, r.linked) for t, r in out.items()} == {None: (None, False), 0: (None, False), 1: (0, False), 2: (1, False), 3: (0, True), 4: (1, True)}
    assert list(map(tuple, out[4].origins)) == [(1, 1, 1), (2, 2, 1)] and out[3].text == "well"
