"""The operators for training data against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, chat, cutting_stock, decontaminate, line_dedup, minhash, packing, quality, token_counts, token_ids, url_filter
from orrery.llm.components import components
from orrery.llm.queries import tokenizer_file
from orrery.llm.shingles import shingle_sets

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [None, "", " ", "\n", "a", "a b", "Ab  C\td\n\n", "é Éß 日本 🙂", "x" * 3000, "w " * 2000, "<|endoftext|> <|startoftext|>hi", "don't I'LL we've 3½", "\xa0b\u2003 c\x1c \x85", "aaa AAA aaa\naaa"]


def texts(spark, rows, *more):
    """Documents with a clashing column or two."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, __pos string, score int")


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    out = list(enumerate(ODD))
    out += [(len(ODD) + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(n)]
    for i in range(n):
        t = (rng.choice(out[len(ODD) :])[1] or "").split(" ")
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((len(out), " ".join(t)))
    return out + [out[-1], (out[-2][0], "another text under the same id"), (None, "no id"), (None, None)]


def test_whole_texts_are_handled_a_few_at_a_time(spark, monkeypatch):
    """However large Spark's batches are, tasks that get and send back whole texts hold a bounded number of rows at once."""
    docs, benchmark = texts(spark, [(1, "a")]), spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    model = quality.Model(*[np.zeros(0)] * 5, np.array([0.0]), np.array([0.5]))
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    quality.score(docs, model)
    decontaminate.drop_leaks(docs.select("doc_id", "text"), benchmark)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2300)), "text": [f"t {i}" for i in range(2300)], "__pos": ["x"] * 2300})
    for f, names in zip(taken, (["doc_id", "text", "__pos"], ["doc_id", "text"]), strict=True):
        out = list(f(iter([batch.select(names)])))
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(2300))
        assert max(b.num_rows for b in out) <= 500


# 1 Chat formatting


def test_chats_round_trip(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\o<|\\b", "", None, "<", "|", "<\\|", "é🙂\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 5, hard, strict=False))]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "first"), (4, 0, "user", "u"), (5, 0, "we\\ird\n<|role", "t"), (None, None, None, None), (6, 1, "user", "x"), (6, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id int, turn int, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].loss_text == "".join(t for r, t in own if r == "assistant")
    assert {c: r.valid for c, r in back.items()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, None: False}
    assert chat.format_chats(df.filter("false")).count() == 0
    for r in chat.format_chats(df).collect():
        # Segments lie one after another and cover the text.
        assert [s.start for s in r.segments] == np.cumsum([0, *(s.length for s in r.segments)])[:-1].tolist() and sum(s.length for s in r.segments) == len(r.formatted)
    with pytest.raises(ValueError):
        chat.ChatTemplate(open="START")


# 2 Packing


def most_value(weights, prices, capacity):
    """The unbounded knapsack, piece by piece."""
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(best[c - w] + v for w, v in zip(weights, prices, strict=True) if w <= c)])
    return best[capacity]


def test_cutting_stock_is_near_its_bound():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 257, 20_000), rng.integers(60, 130, 5000), np.full(1000, 100), np.array([256, 1]), np.minimum(256, rng.geometric(0.02, 100_000)), rng.integers(80, 100, 30_000)):
        h = Counter(sizes.tolist())
        cuts = cutting_stock.plan(h, 256)
        got = Counter()
        for pattern, times in cuts:
            assert sum(w * c for w, c in pattern.items()) <= 256
            got.update({w: c * times for w, c in pattern.items()})
        assert got == h
        # No two pieces over half a stock share one, nor three over a third.
        bound = max(sizes.sum() / 256, (sizes > 128).sum(), (sizes > 256 / 3).sum() / 2)
        # Prices at which no pattern is worth more than a stock are a bound too: 1879.5 for the second histogram, where the one above is 1842.2.
        weights = sorted(h)
        demand = np.array([h[w] for w in weights], dtype=float)
        _, use, prices = cutting_stock.relaxed(np.array(weights), demand, 256, np.diag(256 // np.array(weights)).astype(float), 0.002)
        assert most_value(weights, prices.tolist(), 256) <= 1 + 1e-9
        low = float(prices @ demand)
        assert low <= use.sum() * (1 + 1e-6) and use.sum() <= low / 0.997
        assert sum(x for _, x in cuts) <= max(bound, low) * 1.01 + 1
    assert cutting_stock.plan({}, 10) == []
    with pytest.raises(ValueError):
        cutting_stock.plan({11: 1}, 10)


@pytest.mark.parametrize("length", [64, 300, 2048])
def test_packing(spark, length):
    """Lengths that units divide and don't divide; one unit and several."""
    rows = documents(spark)
    enc = token_ids.Encoder(tokenizer_file(WORD), words=True).library
    made = packing.sequences(texts(spark, rows), tokenizer_file(WORD), end_id=1, length=length, pad_id=9)
    got = packing.read_pieces(made).collect()
    whole = made.collect()
    want = [(i, (*enc.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows]
    cut = Counter((i, at, len(ids[at : at + length]), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)) for i, ids in want for at in range(0, len(ids), length))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == cut
    by_sequence = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == by_sequence.setdefault(r.sequence_id, 0)
        by_sequence[r.sequence_id] += r.length
    total = sum(len(ids) for _, ids in want)
    assert max(by_sequence.values()) <= length and len(by_sequence) <= total / length * 1.15 + 2
    assert {r.sequence_id: r.n_tokens for r in whole} == by_sequence and len(whole) == len(by_sequence)
    for r in whole:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else length) and (ids[r.n_tokens :] == 9).all()
    assert packing.read_pieces(packing.sequences(texts(spark, []), tokenizer_file(WORD), 1, length)).count() == 0


def test_a_class_of_many_tasks_is_packed_whole(spark):
    """All pieces in one class, spread over more tasks than one: every rank is taken once."""
    docs = spark.range(5000).selectExpr("id as doc_id", "'one two three' as text").repartition(7)
    got = packing.read_pieces(packing.sequences(docs, tokenizer_file(WORD), end_id=1, length=64)).collect()
    assert len({r.doc_id for r in got}) == len({(r.sequence_id, r.offset) for r in got}) == 5000 and len({r.sequence_id for r in got}) == 313


# 3 Token ids


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 999, dtype=np.uint64).astype(np.uint32)
    assert (token_ids.unpack(token_ids.pack(ids, bits), 999, bits) == ids).all()
    assert len(token_ids.pack(ids, bits)) == -(-999 * bits // 8)
    assert token_ids.width(2**bits) == bits and token_ids.width(2**bits + 1) == bits + 1


def test_file_has_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 13, n).astype(np.uint32) for n in (0, 5, 300, 1, 0, 1000)]
    w = token_ids.Writer(str(tmp_path / "a"), 13, block=64)
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    w.close()
    r, flat = token_ids.Reader(str(tmp_path / "a")), np.concatenate(docs)
    for a, n in ((0, 1), (63, 2), (64, 64), (1000, 306), (0, 1306), (5, 0)):
        assert (r.ids(a, n) == flat[a : a + n]).all()
    back = list(r.documents())
    assert [x[0] for x in back] == [0, 1, 2, None, 4, 5] and all((x[2] == d).all() for x, d in zip(back, docs, strict=True))


def test_token_ids(spark):
    rows = documents(spark)
    files = token_ids.write_ids(texts(spark, rows), tokenizer_file(BYTE), end_id=2, vocabulary=50_257)
    got = token_ids.read_ids(spark, files).orderBy("start").collect()
    lib = token_ids.Encoder(tokenizer_file(BYTE)).library
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [lib.encode(t or "", add_special_tokens=False).ids + [2]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_ids.read_ids(spark, token_ids.write_ids(texts(spark, []), tokenizer_file(BYTE), 2, 50_257)).count() == 0


@pytest.mark.parametrize(("name", "words"), [(BYTE, False), (WORD, True)])
def test_encoder_is_the_library(name, words):
    import pyarrow as pa

    rng, enc = random.Random(4), token_ids.Encoder(tokenizer_file(name), words)
    enc.memory.size = 50
    some = ODD + ["".join(rng.choice("aabb'’st!.,1é ñßÅΣς\n\t\r\x0b\x1c\xa0\u3000<| ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(pa.array(some))]
        assert got == [enc.library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_an_id_too_large_raises(tmp_path):
    w = token_ids.Writer(str(tmp_path / "a"), 13, block=2)
    with pytest.raises(ValueError):
        w.add(1, np.array([1, 1 << 13], dtype=np.uint32))


# 4 Near-dedup


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_force(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_near_duplicates(spark, k, percent, seed):
    rows = documents(spark, seed)
    got = minhash.near_duplicates(texts(spark, rows), minhash.Rule(k=k, percent=percent)).collect()
    want = components_by_force(rows, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, len(shingles(t, k)), want.get(i), i is None or want[i] == i) for i, t in rows)


def test_a_chain_of_copies_is_one_component(spark, monkeypatch):
    """Small blocks, so that one group spans many tasks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(texts(spark, rows), minhash.Rule(3, 85)).collect()}
    assert got == components_by_force(rows, 3, 85)


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(i, x) for i, x in enumerate([a, b, a[:1024], b[:1024], a[:255] + "q", b[:255] + "q", f"x {a[:200]} y", f"x {b[:200]} y"])]
    assert len({tuple(s.tolist()) for s in shingle_sets([t for _, t in rows], 3)}) == 8
    assert minhash.near_duplicates(texts(spark, rows), minhash.Rule(3, 85)).filter("kept").count() == 8


def test_word_hashes_of_all_sizes():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(n)) for n in range(1, 400) for _ in range(2)]
    one = [s.tolist() for s in shingle_sets(words, 1)]
    assert all(len(s) == 1 for s in one) and len({s[0] for s in one}) == len(set(words))
    # Alike wherever a word stands, and whatever its case.
    assert next(shingle_sets([" ".join(words).upper().replace("É", "é")], 1)).tolist() == sorted({s[0] for s in one})


def test_a_bucket_of_texts_that_are_not_linked(spark, monkeypatch):
    """Boilerplate puts thousands in one bucket; few are linked, some only with a member that is not the smallest."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "DENSE", 256)
    compared = []
    find = minhash._groups
    monkeypatch.setattr(minhash, "_groups", lambda *a: compared.append(find(*a)) or compared[0])
    rng = random.Random(12)
    same = [f"same{i}" for i in range(50)]
    rows = []
    for i in range(1500):
        own = [f"own{i}x{j}" for j in range(30)] if i % 10 or not rows else [w if rng.random() > 0.04 else "new" for w in rows[rng.randrange(len(rows))][1].split()[50:]]
        rows.append((i, " ".join(same + own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(texts(spark, rows), minhash.Rule(3, 85)).collect()}
    want = components_by_force(rows, 3, 85)
    assert got == want and 50 < len(rows) - len(set(want.values())) < 149
    # Prefixes part them: no group of all, and fewer places in groups than a twentieth of the members' shingles.
    assert compared[0].groupBy("group").count().agg(F.max("count")).first()[0] <= 256 and compared[0].count() < 1500 * 78 / 20


def test_links_are_written_to_few_files(spark, monkeypatch):
    """Tables of pairs, which are small, don't come as a file of each task."""
    written = {}

    def staged(df, name, *more, keep=minhash.staged):
        out = keep(df, name, *more)
        written[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(minhash, "staged", staged)
    rng = random.Random(5)
    base = [[f"w{g}x{i}" for i in range(40)] for g in range(30)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"n{rng.randrange(99)}" for w in base[i % 30])) for i in range(240)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(texts(spark, rows), minhash.Rule(3, 85)).collect()}
    assert got == components_by_force(rows, 3, 85)
    assert [written[name] for name in ("likely", "star", "rest")] == [1, 1, 1]


def test_no_documents(spark):
    assert minhash.near_duplicates(texts(spark, [])).count() == 0
    assert minhash.near_duplicates(texts(spark, [(1, None), (2, "")])).filter("kept").count() == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_pruning_keeps_what_the_posterior_keeps():
    least = minhash.Rule(3, 85).least_matches()
    assert least[0] == 0 and least == sorted(least) and 80 < least[-1] < 109


# 5 URL filters


def test_urls(spark):
    urls = [None, "nourl", "http://", "HTTP://A.Com", "x://WWW.Example.com/en/a?b#c", "http://example.com/en/", "http://sub.example.com/en/x", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "http://b.com?q=/en/", "http://bücher.org/é", "http://a.b://c/d", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://good.org/1", "h"), (3, urls[3], "h")], "page_id int, url string, host string")
    labels = spark.createDataFrame([(10, 0), (10, None), (12, 1), (999, 1), (3, 7)], "page_id int, good int")
    from orrery.llm.queries import RULES

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels, RULES).collect()}
    assert got[0][:3] == got[1][:3] == got[14][:3] == ("", "", None) and got[2][:3] == ("", "", None)
    assert got[3][:3] == ("a.com", "", None) and got[4] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[5][2:] == got[6][2:] == ("example.com/en/", "block") and got[7][2:] == ("com/", "allow")
    assert got[8][2:] == ("net/es/", "block") and got[9][2:] == ("net/fr/", "block") and got[10][2] is None and got[11][:3] == ("b.com", "", None)
    assert got[12][:2] == ("bücher.org", "/é") and got[13][:2] == ("a.b:", "//c/d")
    assert url_filter.filter_urls(pages.filter("false"), labels).count() == 0
    assert url_filter.filter_urls(pages, labels.filter("false")).count() == 17
    # Any number of rules: a thousand that don't fit, a longer one that does, and one site twice.
    many = [url_filter.Rule("block", f"h{i}.org/") for i in range(3000)] + [*RULES, url_filter.Rule("block", "sub.example.com/en/x"), url_filter.Rule("block", "www.example.com/en/")]
    more = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels, many).collect()}
    assert more[6] == ("sub.example.com/en/x", "block") and more[4] == ("www.example.com/en/", "allow") and more[8] == ("net/es/", "block")
    assert {k: v[2] for k, v in got.items() if k != 6} == {k: v[0] for k, v in more.items() if k != 6}


def test_levels_of_long_suffixes_and_ports(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk:80",), ("co.uk",), ("x.y.com:8080",), ("com",), ("",)], "host string")
    domain, suffix = url_filter._levels(F.col("host"), ("co.uk",))
    got = [tuple(r) for r in hosts.select("host", domain, suffix).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk:80", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.y.com:8080", "y.com", "com"), ("com", "com", "com"), ("", "", "")]


def test_large_sides_are_salted(spark, small, monkeypatch):
    """The same rows where the small side is too large to broadcast."""
    from orrery.llm import common, queries

    for name in ("op5_url_filter", "op9_line_dedup"):
        want = Counter(map(tuple, queries.queries()[name](spark, small).collect()))
        with monkeypatch.context() as m:
            m.setattr(common, "BROADCAST_BYTES", -1)
            df = queries.queries()[name](spark, small)
            assert "__salt" in df._jdf.queryExecution().toString() and Counter(map(tuple, df.collect())) == want


def test_reputation_shrinks(spark):
    """A host with one bad page among good ones of its domain is trusted more than one among bad ones."""
    pages = [(i, f"http://h{i % 5}.{'good' if i < 200 else 'bad'}.org/{i}") for i in range(400)] + [(1000, "http://new.good.org/"), (1001, "http://new.bad.org/")]
    labels = [(i, int(i < 200)) for i in range(400)] + [(1000, 0), (1001, 0)]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(labels, "page_id int, good int"))
    bound = {r.page_id: r.bound for r in out.collect()}
    assert bound[0] > 0.8 and bound[300] < 0.2 and bound[1000] > bound[1001]


# 6 Nearest neighbours


def near_by_force(x, ids, q, k=5):
    """Rows nearest to row q, and their cosines."""
    y = x.astype(np.float64)
    n = np.sqrt((y * y).sum(1))
    s = (y * y[q]).sum(1) / (n * n[q])
    s[q] = -9
    return np.lexsort((np.arange(len(x)), ids, -s))[:k].tolist(), s


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[1::3] = x[1]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [None] * 16, 0), (None, x[0].tolist(), 0), (5250, [float("inf")] + [0.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    index = ann.build(df)
    assert index.rows.count() == 2000
    got = ann.search(index, index.rows.filter("vec_id % 50 = 0"), 5).collect()
    hit = 0
    for q in range(0, 2000, 50):
        best, s = near_by_force(x, np.arange(2000), q)
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        hit += len(set(best) & {r.vec_id for r in own})
    assert hit / 200 >= 0.9
    few = ann.build(df.filter("vec_id in (0, 50, 51)"))
    assert ann.search(few, few.rows.filter("vec_id % 50 = 0"), 5).count() == 4
    none = ann.build(df.filter("false"))
    assert ann.search(none, none.rows, 5).count() == 0
    one = ann.build(df.filter("vec_id = 0"))
    assert ann.search(one, one.rows, 5).count() == 0


def test_neighbours_among_repeated_ids_and_dimensions(spark):
    """Rows of one id are candidates for each other; dimensions don't mix; very large and small vectors count by direction."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 1e-3]), (50, [1.0, 0.0]), (7, [1e200, 1e200]), (8, [2.0**-600, 0.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.5]), (102, [0.0, 0.0])]
    index = ann.build(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = ann.search(index, index.rows.filter("vec_id % 50 = 0"), 3).collect()
    by = Counter((r.query_id, r.vec_id, r.rank) for r in got)
    assert by == Counter({(50, 8, 1): 3, (50, 50, 2): 3, (50, 50, 3): 3, (100, 101, 1): 1})
    wide = ann.search(index, index.rows.filter("vec_id = 7"), 9).collect()
    assert [r.vec_id for r in sorted(wide, key=lambda r: r.rank)] == [50, 8, 50, 50] and abs(wide[-1].score - 0.5**0.5) < 1e-3


def test_recall_on_embeddings(spark, monkeypatch):
    """All queries of sf0.1 against brute force, over several segments and blocks."""
    monkeypatch.setattr(ann, "SEGMENT", 2048)
    monkeypatch.setattr(ann, "QUERIES", 150)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(2)
    index = ann.build(df)
    got = {}
    for r in ann.search(index, index.rows.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    hit = asked = 0
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        best, s = near_by_force(x, ids, q)
        hit += len({int(ids[j]) for j in best} & {v for _, v, _ in got[int(ids[q])]})
        asked += len(best)
        assert [n for n, _, _ in sorted(got[int(ids[q])])] == [1, 2, 3, 4, 5]
    print("recall", hit / asked, index.shares)
    assert hit / asked >= 0.9


# 7 Token counts


def test_counts(spark):
    rows = documents(spark)
    lib = token_ids.Encoder(tokenizer_file(WORD), True).library
    got = token_counts.count_tokens(texts(spark, rows), tokenizer_file(WORD), limit=50).collect()
    want = Counter((i, len((t or "").encode()), n, n > 50) for i, t in rows for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(texts(spark, []), tokenizer_file(WORD)).count() == 0


def test_merging_is_the_librarys():
    import pyarrow as pa

    c, rng = token_counts.TokenCounter(tokenizer_file(WORD)), random.Random(6)
    some = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 30)] + ["".join(rng.choice("thenaio") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    assert c.counts(pa.array(some)) == [len(c.library.encode(t, add_special_tokens=False).ids) for t in some]


# 8 Decontamination


def edits_by_force(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def fold(s):
    return bytes(decontaminate.folded(np.frombuffer((s or "").encode(), np.uint8))[0])


def test_leaks_by_force():
    rng = random.Random(5)
    for trial in range(150):
        letters = "ab c" if trial % 2 else "abcdefgh  é,."
        word = lambda n, letters=letters: "".join(rng.choice(letters) for _ in range(n))
        item = word(rng.randint(1, 70))
        docs = []
        for _ in range(4):
            t = list(item)
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = word(rng.randint(0, 1))
            docs.append(word(rng.randint(0, 90)) + rng.choice(["", "".join(t)]) + word(rng.randint(0, 40)))
        found = {(a, e) for a, _, e, *_ in decontaminate.find_passages(decontaminate.Index([(1, item)], 0.1), docs)}
        p = fold(item).rstrip(b" ")
        want = {(i, e) for i, d in enumerate(docs) if p for e in [edits_by_force(p, fold(d))] if e <= int(0.1 * len(p))}
        assert found == want


def test_repetitive_texts_are_taken_in_parts(monkeypatch):
    """Halves find what the whole finds."""
    rng = random.Random(7)
    items = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(20, 60)))) for i in range(5)] + [(9, "ab" * 60)]
    docs = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 900))) + rng.choice(items)[1] + "ab" * rng.randint(0, 300) for _ in range(12)] + [None, ""]
    index = decontaminate.Index(items, 0.1)
    hits = lambda: {(a, j, e) for a, j, e, *_ in decontaminate.find_passages(index, docs)}
    whole = hits()
    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    assert hits() == whole and len(whole) > 12
    monkeypatch.undo()
    long = decontaminate.Index([(1, "ab" * 80), (2, "the needle in this very repetitive haystack")], 0.1)
    monkeypatch.setattr(decontaminate, "PAIRS", 50_000)
    got = {(j, e) for _, j, e, *_ in decontaminate.find_passages(long, ["ab" * 4000 + " the needle in this very repetitive haystack"])}
    assert got == {(0, 0), (1, 0)}


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it runs away from all the others."
    near = item.replace("quick", "quikc").upper()
    rows = [(1, f"before {item} after"), (2, f"x {near}\n{item}"), (3, "The quick brown fox"), (4, None), (5, ""), (None, item), (1, item), (6, "word " * 30_000 + item)]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "...", "x"), (None, "zebra crossing ahead of us", "x")], "item_id bigint, text string, doc_id string")
    docs = texts(spark, rows)
    got = decontaminate.find_leaks(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.n_edits) for r in got) == Counter([(1, 7, 0), (2, 7, 0), (None, 7, 0), (1, 7, 0), (6, 7, 0)])
    at = next(r for r in got if r.doc_id == 6)
    assert rows[-1][1].encode()[at.start_byte : at.end_byte].decode().strip(". ") == item.strip(".")
    assert Counter(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == Counter([3, 4, 5])
    assert decontaminate.find_leaks(docs, bench.filter("false")).count() == 0 and decontaminate.find_leaks(docs.filter("false"), bench).count() == 0


def test_parts_of_items_by_force():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh  ,.") for _ in range(n))
    partly = 0
    for _ in range(4):
        item, docs = word(rng.randint(130, 300)), [word(200)]
        for _ in range(6):
            a = rng.randrange(len(item))
            t = list(item[a : a + rng.randint(60, 200)])
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = word(rng.randint(0, 1))
            docs.append(word(rng.randint(0, 90)) + "".join(t) + word(rng.randint(0, 90)))
        p = fold(item).rstrip(b" ")
        n = decontaminate.WINDOW
        windows = [p[at : at + n] for at in {*range(0, len(p) - n, decontaminate.STRIDE), len(p) - n}] if len(p) > n else []
        want = {}
        for i, d in enumerate(docs):
            whole = edits_by_force(p, fold(d))
            part = min((edits_by_force(w, fold(d)) for w in windows), default=n)
            if whole <= len(p) // 10 or part <= n // 10:
                want[i] = whole if whole <= len(p) // 10 else part
                partly += whole > len(p) // 10
        assert {a: e for a, _, e, *_ in decontaminate.find_passages(decontaminate.Index([(1, item)], 0.1), docs)} == want
    assert partly > 3


def test_leaks_whose_middle_line_is_common(spark):
    """Ten documents quote an item, so line dedup takes its middle line from all of them."""
    line = lambda name: " ".join(f"{name} {i * i} {name[::-1]}" for i in range(8))
    item = "\n".join(map(line, ("first", "middle", "last")))
    docs = texts(spark, [(i, f"own {i} " + item + f" {i}") for i in range(10)] + [(10, "nothing of it")])
    left = line_dedup.drop_common_lines(docs, min_docs=10)
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert left.filter(F.col("text").contains("middle")).count() == 0
    assert {r.doc_id for r in decontaminate.find_leaks(left, bench).collect()} == set(range(10))
    assert [r.doc_id for r in decontaminate.drop_leaks(left, bench).collect()] == [10]


def test_benchmarks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    bench = spark.createDataFrame([(i, f"item number {i} has words of its own {i * 7919}") for i in range(12)], "item_id bigint, text string")
    docs = bench.selectExpr("item_id as doc_id", "concat('so ', text) as text")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, rate=0.0).collect()} == {(i, i) for i in range(12)}
    assert decontaminate.drop_leaks(docs, bench).count() == 0


# 9 Line dedup


def test_lines(spark):
    rng = random.Random(3)
    lines = ["Same", " same\t", "SAME\x0b", "É", "é", "", "  ", "rare one", "x y", "\\", "end\r"]
    rows = [(i % 25, "\n".join(rng.choice(lines) + (str(rng.randrange(40)) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "Same\nother"), (None, "same"), (103, "Same\n" * 5000 + "kept")]
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            found.setdefault(key(s), set()).add(i)
    common = {k for k, ids in found.items() if len(k) >= 1 and len(ids) >= 4}
    want = Counter()
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [s for s in own if key(s) not in common]
        want[i, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    out = line_dedup.drop_common_lines(texts(spark, rows), min_docs=4)
    assert Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in out.collect()) == want
    assert out.columns[:4] == ["doc_id", "text", "__pos", "score"]
    assert line_dedup.drop_common_lines(texts(spark, [])).count() == 0


# 10 Quality


def test_quality(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.filter(quality.fold(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, train)
    held = labels.filter(quality.fold(F.col("doc_id")) == 0)
    rows = quality.score(docs, model).join(held, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_input(spark):
    docs = texts(spark, documents(spark))
    label = lambda rows: spark.createDataFrame(rows, "doc_id bigint, label int")
    for rows in ([], [(1, 1), (2, 1)], [(1, None), (2, 7), (None, 1), (10**9, 0)], [(i, i % 2) for i in range(60)] + [(20, 0), (20, 1)]):
        out = quality.score(docs, quality.fit(docs, label(rows)))
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and out.columns == ["doc_id", "text", "__pos", "score"]
    assert quality.score(docs.filter("false"), quality.fit(docs.filter("false"), label([]))).count() == 0
    assert quality.statistics(None) == quality.statistics("") == [0.0] * quality.N_STATS


def test_fit_is_the_direct_solution(spark):
    """The partitions' sums, the solver and the calibration against one matrix in numpy."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = docs.select("doc_id", (F.length("text") % 2).alias("label")).unionByName(docs.filter("doc_id < 9").selectExpr("doc_id", "1 as label"))
    m = quality.fit(docs, labels, n_features=32)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(4)) == 0).alias("h")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, r.label) for r in labels.collect()]
    x = np.array([quality.statistics(text[i]) for i, _ in rows])
    y = np.array([float(b) for _, b in rows])
    own = np.array([not held[i] for i, _ in rows])
    single = np.array([not held[i] for i in text])
    stats = np.array([quality.statistics(t) for t in text.values()])[single]
    assert np.allclose(m.mean, stats.mean(axis=0)) and np.allclose(m.scale, stats.std(axis=0), atol=1e-8)
    f = quality.features(m, x)
    d = f.shape[1]
    weights = np.linalg.solve(f[own].T @ f[own] + 1e-3 * len(rows) * np.eye(d) / 10, f[own].T @ y[own])
    assert np.allclose(m.weights, weights, rtol=1e-5, atol=1e-7)
    raw, level = quality.isotonic(f[~own] @ m.weights, y[~own])
    assert np.allclose(m.raw[1:-1], raw) and np.allclose(m.calibrated[1:-1], level)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    """Nor on copies of rows, which tie."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.filter("doc_id < 100").selectExpr("doc_id + 100000 as doc_id", "text"))
    labels = more.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("label"))
    got = []
    for seed, n in ((1, 3), (2, 7)):
        d, x = (df.orderBy(F.rand(seed)).repartition(n) for df in (more, labels))
        m = quality.fit(d.unionByName(d.limit(5 * seed)), x)
        got.append({r.doc_id: r.score for r in quality.score(more, m).collect()})
    assert got[0] == got[1]


def test_rows_of_one_id_are_bounded(spark):
    """Many labels and many texts under one id."""
    docs = spark.range(3000).selectExpr("1L as doc_id", "concat('text ', id) as text").unionByName(spark.range(2, 200).selectExpr("id as doc_id", "repeat('word ', int(id)) as text"))
    labels = spark.range(5000).selectExpr("1L as doc_id", "int(id % 2) as label").unionByName(spark.range(2, 200).selectExpr("id as doc_id", "int(id % 2) as label"))
    table = quality._learnt(docs, labels, max_labels=500, seed=7)
    assert 300 < table.count() <= 600 and table.filter("n = 5000").count() > 100
    assert quality.score(docs, quality.fit(docs, labels, max_labels=500)).filter("score between 0 and 1").count() == 3198


def test_isotonic_by_force():
    """The level of a point is the largest over starts of the smallest mean over ends."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            x, y, w = rng.integers(0, max(1, n // 2) + 1, n).astype(float), rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
            points = np.unique(x)
            mean = lambda a, b, x=x, y=y, w=w, p=points: np.average(y[(x >= p[a]) & (x <= p[b])], weights=w[(x >= p[a]) & (x <= p[b])])
            want = [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
            centre, level = quality.isotonic(x, y, w)
            assert (np.diff(centre) > 0).all() and (np.diff(level) > 0).all() and np.allclose(sorted(set(np.round(want, 9))), level)
            order = rng.permutation(n)
            assert [v.tolist() for v in quality.isotonic(x[order], y[order], w[order])] == [centre.tolist(), level.tolist()]


def test_isotonic():
    x, y = np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1])
    raw, level = quality.isotonic(x, y)
    assert raw.tolist() == [1, 2.5, 4] and level.tolist() == [0, 0.5, 1]


def test_folds(spark):
    got = spark.range(50).select("id", quality.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_digest_is_of_the_kept_text(spark):
    """The line query's digest, by hand."""
    from orrery.llm.queries import op9_line_dedup

    rows = op9_line_dedup(spark, "/root/testdata/sf0.001").filter("n_dropped = 0").limit(3).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows and all(hashlib.sha256(docs[r.doc_id].encode()).hexdigest() == r.kept_sha256 for r in rows)
