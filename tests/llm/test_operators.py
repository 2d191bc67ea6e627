"""Each operator against a brute-force version, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cadenza.llm import queries
from oracle import same
from pyspark.sql import functions as F

from conftest import SF

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(None, "a text without id"), (1, None), (2, ""), (3, "   \n\t "), (4, "12 !!"), (5, "one two"), (5, "one two"), (6, "Ein Wort\nund  noch eins\x0bhier <|endoftext|> it's"), (7, "Ein Wort\nund  noch eins\x0bhier <|endoftext|> it's"), (8, "x" * 70_000), (9, "wort " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(i, t, "de" if i and i % 2 else "en", 1, "s", b"k") for i, t in ODD]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, id long, digest string, k0 binary").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name])


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_bpe_is_the_librarys():
    from cadenza.llm.bpe import BatchBPE

    texts = ["", " ", "  a  b\n\n c ", "it's we'll 's 'says I'd've", "''s '''t a'", "<|endoftext|>", "a<|endoftext|> b", "\x00nul\x00", "日本 テスト１２ 12ab", "emoji 😀", "tab\t\tx  ", "don'tt 2'll\n's", " wide space", "été Ñandú ß", "x" * 3000]
    rng = random.Random(1)
    texts += ["".join(rng.choices("ab'sl \n\t1.é", k=rng.randint(0, 30))) for _ in range(300)]
    ids, offsets = BatchBPE(BPE).encode(texts)
    library = tokenizer()
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_language(spark, docs, odd, empty):
    from cadenza.llm.language import ByteConvNet, predict_languages, windows

    got = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.85 and got.score.between(0, 1).all()
    assert set(got[got.held_out].doc_id) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 4 == 2}
    out = predict_languages(odd).toPandas()
    assert len(out) == len(ODD) and set(out[out.doc_id.isin([1, 2, 3, 4])].lang_pred) == {"und"} and (out[out.doc_id == 9].lang_pred != "und").all()
    assert predict_languages(empty).count() == 0
    # Tables and the plain convolution give the same network.
    net = ByteConvNet.fresh(["a", "b"])
    x, _, _ = windows(np.frombuffer(b"some bytes \xc3\xa9 " * 40, np.uint8), np.array([0, 560]))
    e = net.embed[x]
    pooled = [np.stack([sum(e[:, i + j] @ f[j] for j in range(w)) for i in range(x.shape[1] - w + 1)], 1).max(1) for w, f in zip((2, 3, 4), net.filters, strict=True)]
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(net.log_odds(x, net.tables()), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)


def test_network_gradient():
    from cadenza.llm.language import ByteConvNet, _softmax

    net, rng = ByteConvNet.fresh(["a", "b", "c"]), np.random.default_rng(0)
    net.embed = net.embed.astype(np.float64)
    x, y = rng.integers(1, 255, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def loss():
        e = net.embed[x]
        pooled = [np.stack([sum(e[:, i + j] @ f[j] for j in range(w)) for i in range(20 - w + 1)], 1).max(1) for w, f in zip((2, 3, 4), net.filters, strict=True)]
        p = _softmax(np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias)
        return -np.log(p[np.arange(5), y]).mean()

    grads = net._gradients(x, y)
    b, k = int(x[0, 3]), 2
    base = loss()
    net.embed[b, k] += 1e-5
    assert (loss() - base) / 1e-5 == pytest.approx(grads[0][b, k], abs=1e-3)


def words(t):
    return (t or "").encode().lower().split()


def test_language_model(spark, docs, odd, empty):
    from cadenza.llm.hpylm import score_texts

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in score_texts(docs, block_bytes=1 << 16).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        tokens = [*words(t), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(count[w] > 0 for w in tokens), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    train = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)
    assert score_texts(odd).count() == len(ODD) and score_texts(empty).count() == 0


def test_language_model_beats_the_base_on_held_out_texts(spark):
    from cadenza.llm.hpylm import score_texts

    got = score_texts(spark.read.parquet(f"{SF[:-3]}01/documents.parquet").select("doc_id", "text")).filter("held_out").toPandas()
    assert len(got) > 100 and got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum()


def test_joined_tallies():
    from cadenza.llm import hpylm as H

    rng = np.random.default_rng(2)
    parts = [np.sort(rng.choice(200, rng.integers(1, 90), replace=False)).astype(np.uint64) for _ in range(7)]
    want = Counter(int(k) for p in parts for k in p)
    key, count = H._merge([(p, np.ones(len(p), np.uint32)) for p in parts])
    assert (np.diff(key.astype(int)) > 0).all() and dict(zip(key.tolist(), count.tolist(), strict=True)) == dict(want)


def test_restaurants_are_normalised():
    from cadenza.llm import hpylm as H

    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"abc "), 4000).tolist())
    sym, offs, *_ = H.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    key, count = H._tally(H.grams(sym, offs), np.ones(len(sym), np.int64))
    context = np.unique(key >> np.uint64(8))[:5]
    every = (context[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    both, counts = H._tally(np.concatenate([key, every]), np.concatenate([count, np.zeros(len(every), np.int64)]))
    p, _ = H.sample_part(both, counts, H.low_orders(np.bincount((key & np.uint64(0xFFFF)).astype(int), minlength=65536)), seed=0)
    total = p[np.searchsorted(both, every)].reshape(5, 256).sum(1)
    assert np.allclose(total, 1, atol=1e-6)


def test_token_counts_and_cache(spark, docs, odd, empty, tmp_path):
    from cadenza.llm.token_count import count_tokens

    cache, library = f"file://{tmp_path}/cache", tokenizer()
    for frame in (docs.select("doc_id", "text"), odd, odd):
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.collect()), key=str)
        got = count_tokens(frame, BPE, cache)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=str) == want
        assert got.filter("over_limit <> (n_tokens > 1024)").count() == 0
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r.text or "" for f in (docs, odd) for r in f.collect()})
    assert count_tokens(empty, BPE, cache).count() == 0


def test_cache_with_repeated_entries(spark, odd, tmp_path, monkeypatch):
    """Entries that two writers appended count once, and many misses go another way than few."""
    from cadenza.llm import token_count

    cache = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_count.count_tokens(odd, BPE, cache).collect()), key=str)
    spark.read.parquet(cache).write.parquet(f"file://{tmp_path}/copy")
    spark.read.parquet(f"file://{tmp_path}/copy").write.mode("append").parquet(cache)
    assert sorted(map(tuple, token_count.count_tokens(odd, BPE, cache).collect()), key=str) == first
    assert spark.read.parquet(cache).count() == 2 * len({t or "" for _, t in ODD})  # nothing was encoded again
    monkeypatch.setattr(token_count, "FEW", 2)
    assert sorted(map(tuple, token_count.count_tokens(odd, BPE, f"file://{tmp_path}/other").collect()), key=str) == first


def test_sharding(spark, docs, odd, empty):
    from cadenza.llm.sharding import assign_shards, lookup_table

    names = [f"s{i}" for i in range(7)]
    size = 251
    table, free, at = [-1] * size, size, [0] * 7
    prefer = []
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefer.append([(a + j * b) % size for j in range(size)])
        assert sorted(prefer[-1]) == list(range(size))
    while free:
        for s in range(7):
            while table[prefer[s][at[s]]] >= 0:
                at[s] += 1
            table[prefer[s][at[s]]] = s
            free -= 1
            if not free:
                break
    assert lookup_table(names, size) == table and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = lookup_table(names[:-1], size)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < size / 4
    got = assign_shards(docs.select("doc_id"), names, size=size).collect()
    assert all(r.slot == int(hashlib.sha256(str(r.doc_id).encode()).hexdigest()[:15], 16) % size and r.shard == table[r.slot] and r.shard_name == names[r.shard] for r in got) and len(got) == docs.count()
    clash = assign_shards(odd.withColumn("slot", F.lit(1)), names, size=size)
    assert clash.count() == len(ODD) and clash.columns.count("slot") == 1 and assign_shards(empty, names).count() == 0
    with pytest.raises(ValueError):
        lookup_table(names, 10)


def components(nodes, links):
    root = {i: i for i in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in nodes}


def brute_near(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            common.update((j, i) for j in where[x])
            where[x].append(i)
    links = [(a, b) for (a, b), c in common.items() if den * c >= num * (len(sets[a]) + len(sets[b]) - c)]
    return sets, components(sets, links)


@pytest.mark.parametrize(("k", "num", "block"), [(3, 85, 2048), (5, 80, 2048), (3, 85, 8)])
def test_near_duplicates(spark, docs, monkeypatch, k, num, block):
    """Also with buckets that are cut into many blocks."""
    from cadenza.llm import near_dedup
    from cadenza.llm.near_dedup import near_duplicates

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(k)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(150):  # one large group of copies that differ in a few places, many pairs of them too far apart
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(120)] = f"v{rng.randint(0, 10**6)}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000 + i, "the same short text") for i in range(60)]
    sets, label = brute_near(rows, k, num, 100)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in near_duplicates(frame, shingle=k, num=num, den=100).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], r.doc_id == label[r.doc_id])


def test_near_duplicates_odd(odd, empty):
    from cadenza.llm.near_dedup import near_duplicates

    got = near_duplicates(odd, shingle=3).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert by[7].component_id == 6 and by[None].component_id is None and by[9].n_shingles == 1
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    from cadenza.llm.components import connected_components

    rng = random.Random(2)
    path = [(i, i + 1) for i in range(1, 200)]
    links = path + [(1000 + rng.randint(0, 50), 1000 + rng.randint(0, 50)) for _ in range(40)] + [(5000, 5000 + i) for i in range(1, 300)]
    want = components({x for e in links for x in e if e[0] != e[1]}, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, odd, empty, tmp_path, bits):
    from cadenza.llm.exact_dedup import stream_dedup

    odd.write.parquet(f"{tmp_path}/odd")
    got = stream_dedup(spark, f"{tmp_path}/odd", digest_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    assert len(got) == len(ODD)
    best = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == best[r.text_sha256] for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == {k: 1 for k in best}
    empty.write.parquet(f"{tmp_path}/none")
    assert stream_dedup(spark, f"{tmp_path}/none").count() == 0


def test_exact_dedup_keeps_state(spark, tmp_path):
    from cadenza.llm.exact_dedup import stream_dedup

    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    frame([(1, "a"), (2, "b")]).write.parquet(f"{tmp_path}/t")
    stream_dedup(spark, f"{tmp_path}/t", state_dir=f"file://{tmp_path}/state").count()
    frame([(3, "a")]).write.mode("append").parquet(f"{tmp_path}/t")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in stream_dedup(spark, f"{tmp_path}/t", state_dir=f"file://{tmp_path}/state").collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_best_fit_rule():
    from cadenza.llm.packing import BestFit

    rng = random.Random(3)
    fit, bins, open_ = BestFit(100, 8), [], []
    for _ in range(2000):
        size = rng.randint(1, 100)
        able = [b for b in open_ if 100 - sum(b) >= size]
        got = fit.add(size, size)
        if able:
            into = max(able, key=sum)
            into.append(size)
        else:
            if len(open_) == 8 and size < 100:
                full = max(open_, key=sum)
                open_.remove(full)
                assert sum(got) == sum(full)
            into = [size]
            open_.append(into)
        if sum(into) == 100:
            open_.remove(into)
            assert sum(got) == 100
        if got:
            bins.append(got)
    assert all(sum(b) <= 100 for b in bins) and sorted(sum(b) for b in fit.rest()) == sorted(sum(b) for b in open_)


def test_packing(spark, docs, odd, empty):
    from cadenza.llm.packing import pack_documents

    library = tokenizer()
    for frame in (docs.select("doc_id", "text"), odd):
        want = Counter()
        for r in frame.collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            head = len(ids) % 2048 or 2048
            cuts = [0, *range(head, len(ids) + 1, 2048)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[(r.doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
        got = pack_documents(frame, BPE).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        seqs = defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in got)
        assert len(seqs) <= math.ceil(total / 2048) * 1.05 + 1
    assert pack_documents(empty, BPE).count() == 0


def test_subwords(spark, odd, empty):
    from cadenza.llm.subword import Lattice, decode_segmentations, sample_segmentations

    lattice = Lattice.get(PIECES)

    model = lattice.model
    weight_of = {model.id_to_piece(i): (i, 1 / (2.7 - max(model.get_score(i), -1e6))) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and (model.get_score(i) > -1e8 or len(model.id_to_piece(i)) == 1)}
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}

    def every(word):
        out = {}

        def go(at, ids, p):
            if at == len(word):
                out[tuple(ids)] = p
            for j in range(at + 1, len(word) + 1):
                if word[at:j] in weight_of:
                    i, w = weight_of[word[at:j]]
                    go(j, [*ids, i], p * w)
            if at < len(word) and word[at] not in weight_of:
                raw = word[at].encode()
                go(at + 1, [*ids, *(byte[b] for b in raw)], p / (2.7 + len(weight_of)) ** len(raw))

        go(0, [], 1.0)
        return {ids: math.log(p / sum(out.values())) for ids, p in out.items()}

    for text in ("the", "x😀", "nation"):
        (word,) = lattice.words(text)
        all_ = every(word)
        assert sum(map(math.exp, all_.values())) == pytest.approx(1)
        n, first, weight = 1500, Counter(), Counter()
        for i in range(n):
            got = lattice.sample(text, 3, str(i).encode())
            assert len({tuple(g[0]) for g in got}) == len(got) == min(3, len(all_))
            for ids, lp, q in got:
                assert lp == pytest.approx(all_[tuple(ids)], abs=1e-9) and 0 < q <= 1  # GRAIN
                weight[tuple(ids)] += 1 / q / n
            first[tuple(got[0][0])] += 1 / n
        top = max(all_, key=all_.get)
        assert first[top] == pytest.approx(math.exp(all_[top]), abs=0.05) and weight[top] == pytest.approx(1, abs=0.15)
    # Far into a text, where nothing else can be wanted any more, words are cut by their own probabilities.
    text, last = "a walk along the river " * 12 + "nation", Counter()
    all_ = every("\u2581nation")
    for i in range(600):
        for ids, _, _ in lattice.sample(text, 2, str(i).encode()):
            assert model.decode(ids) == text
            last[next(s for s in all_ if tuple(ids[-len(s) :]) == s and model.id_to_piece(s[0]).startswith("\u2581"))] += 1 / 1200
    for s, lp in all_.items():
        assert last[s] == pytest.approx(math.exp(lp), abs=0.06)
    out = decode_segmentations(sample_segmentations(odd.withColumn("original", F.col("text")), PIECES, 2, key_cols=["doc_id", "original"]), PIECES)
    rows = out.collect()
    assert all(r.decoded == (r.original or "") for r in rows) and {r.doc_id for r in rows} == {i for i, _ in ODD}
    again = sample_segmentations(odd.repartition(1), PIECES, 2, key_cols=["doc_id", "text"]).collect()
    once = sample_segmentations(odd.repartition(4), PIECES, 2, key_cols=["doc_id", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, once))
    assert sample_segmentations(empty, PIECES, key_cols=["doc_id"]).count() == 0


def test_subword_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = queries.op8_subword_sampling(spark, SF).toPandas()
    assert got.round_trip.all() and got.inclusion.between(0, 1).all() and (got.log_prob <= 0).all()
    assert got[got["sample"] == 1].groupby(["conv_id", "turn"]).size().sum() == turns.count()
    assert not got.duplicated(["conv_id", "turn", "ids_sha256"]).any() or turns.count() > turns.select("conv_id", "turn").distinct().count()


def eligible(L, x):
    y = L.normalise(x).encode()
    return len(y.split()) >= L.MIN_WORDS or len(y) >= L.MIN_BYTES


def brute_lines(L, rows):
    """Lines (id, number) that repeat an earlier one exactly, and all that go if every near-equal pair is found."""
    first, twin = {}, set()
    for i, t in sorted(rows):
        for k, x in enumerate((t or "").split("\n")):
            y = L.normalise(x)
            if y and first.setdefault(y, (i, k)) != (i, k):
                twin.add((i, k))
    order = sorted((y for y in first if eligible(L, y)), key=len)
    links = []
    for i, x in enumerate(order):
        near = [y for y in order[i + 1 :] if 5 * len(x) >= 4 * len(y)]
        links += [(first[x], first[y]) for y, ok in zip(near, L.similar([x] * len(near), near), strict=True) if ok] if near else []
    of = components(first.values(), links)
    return twin, twin | {at for at, root in of.items() if at != root}, links


def cut(rows, gone):
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines(spark, docs, odd, empty):
    from cadenza.llm import line_dedup as L

    rng = random.Random(5)
    line = " ".join(f"w{rng.randint(0, 999)}x{rng.randint(0, 9)}" for _ in range(60))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(80):
        near = line.split(" ")
        near[rng.randrange(60)] = "zz"
        rows.append((9000 + i, "yes  SIR\n\n" + " ".join(near) + "\n| a | b | c | d | e |\n" + line))
    twin, every, links = brute_lines(L, rows)
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(links) > 900 and {(9000 + i, k) for i in range(1, 80) for k in (0, 3, 4)} <= twin
    want = cut(rows, every)
    assert {i: got[i].text for i, _ in rows} == want
    for i, t in rows:
        assert got[i].n_lines == t.count("\n") + 1 and got[i].lines_dropped == sum((i, k) in every for k in range(got[i].n_lines))
    clash = odd.withColumn("n_lines", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("_mark", F.lit(2)).withColumn("gone", F.lit(3)).withColumn("row", F.lit(4))
    out = L.dedup_lines(clash)
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD) and by[1].text is None and by[2].text == "" and by[9].lines_dropped == 0 and set(clash.columns) < set(out.columns)
    assert by[6].text == ODD[7][1] and by[7].lines_dropped == 2 and by[7].text == "" and by[7].gone == 3
    assert L.dedup_lines(empty).count() == 0


def changed(rng, kind, line):
    """A near copy of a line, given as words, by kind of change."""
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    if isinstance(kind, float):  # scattered letters
        text = list(" ".join(line))
        for i in rng.sample([i for i, c in enumerate(text) if c != " "], max(1, int(len(text) * kind))):
            text[i] = "q"
        return "".join(text)
    line = list(line)
    if kind == "letter":
        i = rng.randrange(len(line))
        k = rng.randrange(len(line[i]))
        line[i] = line[i][:k] + "q" + line[i][k + 1 :]
        return " ".join(line)
    for i in rng.sample(range(len(line)), max(1, int(len(line) * {"word": 0, "tenth": 0.1, "fifth": 0.2}[kind]))):
        line[i] = word()
    return " ".join(line)


def test_recall_of_near_lines(spark):
    """Short and long lines against all pairs by edit similarity alone."""
    from cadenza.llm import line_dedup as L

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices(["er", "en", "ch", "lo", "mi", "s", "t", "ring", "tion", "a", "o"], k=rng.randint(1, 4))) for _ in range(800)]
    rows, kinds = [], {}
    for n in (5, 6, 10, 15, 25, 60, 100):
        for kind in ("letter", "word", "tenth", "fifth", 0.05):
            for _ in range(40):
                line = rng.choices(vocabulary, k=n)
                kinds[len(rows) + 1] = kind
                rows += [(len(rows), " ".join(line)), (len(rows) + 1, changed(rng, kind, line))]
    rows += [(len(rows) + k, "\u6c49\u5b57\u8a9e\u6587" * 12 + "\u4e00\u4e8c\u4e09"[k]) for k in range(3)]
    twin, every, _ = brute_lines(L, rows)
    got = {r.doc_id for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.lines_dropped}
    want = {i for i, _ in every}
    assert got <= want and {i for i, _ in twin} <= got and {rows[-1][0], rows[-2][0]} <= got
    for kind in set(kinds.values()):
        own = {i for i in want if kinds.get(i) == kind}
        assert len(own) > 100 and len(own & got) >= 0.9 * len(own), kind


def test_digits_and_short_lines(spark):
    """Lines that differ in digits are different; of short equal lines only those of the least length go."""
    from cadenza.llm import line_dedup as L

    rows = [(0, "in 1999\n77\n}\nyes"), (1, "in 2024\n34\n}\nyes"), (2, "in  1999\n77 \n}\n"), (3, "total of 12 parts in box 1 of 90\ntotal of 12 parts in box 2 of 90")]
    out = lambda **k: {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **k).collect()}
    assert out() == {0: rows[0][1], 1: "in 2024\n34", 2: "", 3: "total of 12 parts in box 1 of 90"}
    assert out(least_bytes=3) == {0: rows[0][1], 1: "in 2024\n34\n}", 2: "77 \n}\n", 3: "total of 12 parts in box 1 of 90"}


def test_large_groups_of_lines(spark, monkeypatch):
    """Buckets in blocks, cut by fields, and components joined across blocks, as on much larger tables."""
    from cadenza.llm import line_dedup as L

    monkeypatch.setattr(L, "PAIRS", 2)
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    frame = " ".join(word() for _ in range(6))
    rows = []
    for g in range(6):
        base = [word() for _ in range(14)]
        for _ in range(20):
            line = list(base)
            line[rng.randrange(14)] = word()
            rows.append((len(rows), frame + " " + " ".join(line)))
    rng.shuffle(rows)
    _, every, _ = brute_lines(L, rows)
    got = {r.doc_id for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.lines_dropped}
    assert got == {i for i, _ in every}


def test_normalised_lines():
    from cadenza.llm import line_dedup as L
    from cadenza.llm.kernel import strings

    rng = random.Random(3)
    texts = ["".join(rng.choices("aB 9\t\n\u00e9\x0b\u3000", k=rng.randint(0, 40))) for _ in range(400)]
    data, offsets = strings(pa.array(texts))
    text, edge = L.normalised(data, L.line_offsets(data, offsets)[0])
    assert [text[a:b].tobytes().decode() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [L.normalise(x) for t in texts for x in t.split("\n")]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        best = [i]
        for j, y in enumerate(b, 1):
            best.append(min(row[j] + 1, best[-1] + 1, row[j - 1] + (x != y)))
        row = best
    return row[-1]


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_edit_distance(monkeypatch, few):
    from cadenza.llm import edits as E

    monkeypatch.setattr(E, "FEW", few)
    rng = random.Random(6)
    left, right, most, want = [], [], [], []
    for n in [12] * 800 + [200] * 60:
        a = "".join(rng.choices("ab\u00e9\u65e5 ", k=rng.randint(0, n)))
        b = "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else "".join(rng.choices("ab\u00e9", k=rng.randint(0, n)))
        d = plain_distance(a, b)
        limit = max(0, d + rng.randint(-2, 2))
        assert E.edit_distance(a, b, d) == d and (not d or E.edit_distance(a, b, d - 1) == d)
        left.append(a), right.append(b), most.append(limit), want.append(d <= limit)
    assert E.within(left, right, most).tolist() == want


def test_top_k(spark, monkeypatch):
    from cadenza.llm import knn

    monkeypatch.setattr(knn, "DATA_BLOCK", 64)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 4, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.3, 8)).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)] + [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [1.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ok = {i: np.pad(np.floor(np.array(v) * 64).astype(int), (0, 8 - len(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted(((-int(ok[q] @ x), i) for i, x in ok.items() if i != q))[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = {tuple(r) for r in knn.voronoi_top_k(frame, F.col("id") % 20 == 0).collect()}
    assert got == want
    assert knn.voronoi_top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0
    few = knn.voronoi_top_k(frame.filter("vec_id IN (0, 1, 2)"), F.col("id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]


def test_top_k_with_repeated_ids_and_further_columns(spark, monkeypatch):
    """Ids that occur often, as queries and as candidates, near a pivot that others are far from."""
    from cadenza.llm import knn

    monkeypatch.setattr(knn, "DATA_BLOCK", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(9)
    rows = [(0, (np.array([5.0] * 4) + rng.normal(0, 0.01, 4)).tolist()) for _ in range(60)]
    rows += [(20, (np.array([5.0] * 4) + rng.normal(0, 0.01, 4)).tolist()) for _ in range(3)] + [(i, rng.normal(0, 1, 4).tolist()) for i in range(1, 120) if i != 20]
    frame = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], "vec_id long, embedding array<double>, id int, cell int, far int, v string, block int").repartition(3)
    ints = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows]
    want = []
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = sorted((-int(a @ b), j) for i, a in ints if i == q for j, b in ints if j != q)[:7]
        want += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in knn.voronoi_top_k(frame, F.col("id") % 20 == 0, 7).collect()) == sorted(want)


def test_top_k_of_large_values(spark):
    from cadenza.llm.knn import voronoi_top_k

    big = 2**27
    rows = [(0, [big, 1]), (1, [big, 2]), (2, [big, 3]), (3, [big, 5]), (4, [-big, 0])]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = voronoi_top_k(frame, F.col("id") == 0, 3, scale=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, big**2 + 5), (2, big**2 + 3), (1, big**2 + 2)]
    with pytest.raises(ValueError):
        voronoi_top_k(frame, F.col("id") == 0, 3, scale=float(2**20))


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == docs.columns and now.count() <= before.count(), name
    packed = P.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    assert 0.5 * docs.count() < now.count() < docs.count()


def test_pipeline_letter_rule_without_labels(spark):
    import corpus_pipeline as P

    rows = [(1, "plain words", None, "s", 11), (2, "123 --- 456", None, "s", 11), (3, "", None, "s", 0), (4, None, None, "s", 0), (5, "\u4e2d", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.identify_language(spark, docs, SF)
    assert out.columns == P.COLUMNS and {r.doc_id for r in out.collect()} == {1, 5}


def test_long_sets_just_below_the_threshold_are_left_to_full_sets():
    from cadenza.llm import near_dedup as N

    rng = np.random.default_rng(4)
    n, common = 1_000_000, 888_880  # 888,889 shared shingles reach 0.8
    every = np.unique(rng.integers(0, 1 << 54, 2 * n - common + 1000, dtype=np.uint64))
    every = rng.permutation(every)[: 2 * n - common]
    sets = [np.sort(every[:n]), np.sort(every[n - common :])]
    full = pa.record_batch([pa.array([1, 2]), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "shingles"])
    short = next(N._short(iter([full]))).column(1)
    sketch = np.arange(64, dtype=np.uint16)
    bucket = int(N._bucket(sketch.view(np.uint64)[:1], 0)[0])
    col = {"bucket": [bucket] * 2, "lo": [0, 0], "hi": [0, 0], "block": [0, 0], "id": [1, 2], "n": [n, n], "comp": [1, 2]}
    rows = pa.record_batch([*(pa.array(v, pa.int64()) for v in col.values()), pa.array([sketch.tobytes()] * 2, pa.binary()), short], [*col, "sketch", "short"])
    found = [r for b in N._rest(80, 100)(iter([rows])) for r in b.to_pylist()]
    assert found == [{"a": 1, "b": 2, "sure": False}]
