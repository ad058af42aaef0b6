import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import awkward, awkward_rows, base_counts, empty, personal, prose, shingles, smallest_reachable, WORDS
from tokenizers import Tokenizer
from pyspark.sql import functions as F
from tokenizers.models import Unigram

from tidemark.llm import bpe, charclass, graph, jaccard, langid, mixing, pii, quality, sharding, tokencount, tokenfile, vectors
from tidemark.llm.common import fresh_folder


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def key(text):
    return hashlib.sha256(("" if text is None else "t" + text).encode()).hexdigest()


# --- sharding


def check_shards(rows, texts, n_shards):
    assert len(rows) == len(texts)
    counts, slots = Counter(r["shard"] for r in rows), defaultdict(list)
    assert all(0 <= s < n_shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    expected = Counter((16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == expected


def test_shards_awkward(spark):
    check_shards(sharding.shard_documents(awkward(spark), n_shards=5).collect(), [r[1] for r in awkward_rows()], 5)
    assert sharding.shard_documents(empty(spark), n_shards=5).collect() == []


def test_shards_keep_groups_and_split_a_hot_one(spark):
    texts = ["hot"] * 150 + [f"pair {i // 2}" for i in range(150)] + [f"single {i}" for i in range(100)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_shards=8).collect()
    check_shards(rows, texts, 8)
    at = defaultdict(set)
    for r in rows:
        at[texts[r["doc_id"]]].add(r["shard"])
    pairs = [len(v) for k, v in at.items() if k.startswith("pair")]
    assert sum(n == 1 for n in pairs) >= 0.9 * len(pairs)
    assert len(at["hot"]) <= 7


# --- mixing


def level_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share, stop what is above its cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def sainte_lague(targets, order, blocks):
    seats = dict.fromkeys(order, 0)
    for _ in range(blocks):
        best = max(order, key=lambda s: (targets[s] / (2 * seats[s] + 1), -order.index(s)))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("case", ["awkward", "capped", "table"])
def test_mixing(spark, sf_dir, case):
    if case == "awkward":
        docs = awkward(spark)
    elif case == "capped":
        docs = spark.createDataFrame([(i, prose(i, 30 + i), "ABCDEF"[min(5, i // 7)]) for i in range(90)] + [(1000, "a b", "Z")], "doc_id long, text string, source string")
    else:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select("doc_id", "text", "source").collect()
    rows = mixing.mix_documents(docs).collect()
    words = [len(WORDS.findall(r["text"] or "")) for r in raw]
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], n) for r, n in zip(raw, words))
    sizes = Counter()
    for r, n in zip(raw, words):
        sizes[r["source"]] += n
    targets = level_targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        assert sum(x["words"] for x in r["shards"]) == r["taken"] and all(0 <= x["shard"] < 40 and x["words"] > 0 for x in r["shards"])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    seats = sainte_lague(targets, order, sum(sizes.values()) // 16)
    assert all(taken[s] == min(16 * seats[s], 3 * sizes[s]) for s in order)
    # Every prefix of shards holds what the method gives it.
    for upto in (0, 7, 38):
        seats = sainte_lague(targets, order, sum(sizes.values()) // 16 * (upto + 1) // 40)
        held = Counter()
        for r in rows:
            held[r["source"]] += sum(x["words"] for x in r["shards"] if x["shard"] <= upto)
        assert all(held[s] == min(16 * seats[s], 3 * sizes[s]) for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(docs).collect()))


def test_mixing_empty(spark):
    assert mixing.mix_documents(empty(spark)).collect() == []


def test_quotas_by_shard(spark):
    targets = spark.createDataFrame([(0, 1000.0, 2000), (1, 700.0, 2000), (2, 300.0, 2000)], "place int, target double, total long")
    rows = mixing.block_quotas(targets, 1, 7).collect()
    for s in range(7):
        upto = {r["place"]: r["quota"] + r["quota_before"] for r in rows if r["shard"] == s}
        assert upto == sainte_lague({0: 1000, 1: 700, 2: 300}, [0, 1, 2], 2000 * (s + 1) // 7)


def test_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    mix = spark.createDataFrame([(1, 10, 30), (2, 10, 4), (3, 10, 15)], "doc_id long, size long, taken long")
    assert Counter(r["doc_id"] for r in mixing.mixed_copies(docs, mix).collect()) == {1: 3, 3: 2}


# --- embeddings


def brute_vectors(rows, threshold=0.93):
    unit = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        unit.setdefault(i, set()).add((label, tuple(np.array(v, float) / np.linalg.norm(np.array(v, float)))))
    ids = {i for i, _, _ in rows if i is not None}
    linked = lambda a, b: any(la == lb and len(x) == len(y) and np.dot(x, y) >= threshold - 1e-12 for la, x in unit.get(a, ()) for lb, y in unit.get(b, ()))
    return {a: sum(linked(a, b) for b in ids if b != a) for a in ids}, smallest_reachable(ids, linked)


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links(spark, block):
    rng, rows = np.random.default_rng(5), []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(1 + c % 9):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + 0.12 * rng.normal(size=16)], c % 3))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(12)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, rows[3][1], None), (2006, rows[3][1][:8], 1), (2007, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[3][1], 0, "x", 1)], "vec_id long, embedding array<float>, label int, key string, id int")
    got = {r["vec_id"]: r for r in vectors.embedding_links(df, block=block).collect()}
    n, comp = brute_vectors(rows)
    assert len(got) == len(rows) + 1 and got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert sum(got[i]["n_links"] for i in n) >= 0.97 * sum(n.values())
    assert all(got[i]["n_links"] <= n[i] for i in n)
    assert sum(got[i]["component_id"] == comp[i] for i in comp) >= 0.97 * len(comp)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in n)
    assert vectors.embedding_links(df.limit(0)).collect() == []


# --- token counts


def test_token_counts(spark):
    scores, _ = tokencount.zipf_pieces(P.path("piece_bpe_32k.model"))
    lib = Tokenizer(Unigram([("<unk>", -1e3), *scores.items()], 0))
    rows = awkward_rows()
    out = tokencount.token_counts(awkward(spark), P.path("piece_bpe_32k.model")).collect()
    assert len(out) == len(rows)
    got = Counter((r["doc_id"], r["n_words"]) for r in out)
    assert got == Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in rows)
    counter = tokencount.TrieCounter(*tokencount.zipf_pieces(P.path("piece_bpe_32k.model")))
    words = {f"{a}{b}" for a in ("under", "over", "inter", "x") for b in ("", "standing", "national", "rated", "9", "e" * 70)}
    assert {w: counter.count(w) for w in words} == {w: len(lib.encode(tokencount.START + w).ids) for w in words}
    assert counter.count("\U0001f980") >= 2  # a sign without a piece: its bytes
    small = tokencount.TrieCounter(*tokencount.zipf_pieces(P.path("piece_bpe_32k.model")), nodes=50, memo=9)
    assert small.of_texts([r[1] for r in rows]) == counter.of_texts([r[1] for r in rows])  # giving up tries changes no count
    assert tokencount.token_counts(empty(spark), P.path("piece_bpe_32k.model")).collect() == []


def test_token_counts_are_the_library_model(spark, sf_dir):
    """n_tokens of every document of the table whose characters all have pieces, against the library's unigram model."""
    path = P.path("piece_bpe_32k.model")
    scores, _ = tokencount.zipf_pieces(path)
    lib = Tokenizer(Unigram([("<unk>", -1e3), *scores.items()], 0))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    counted, memo = 0, {}

    def n_tokens(word):
        if word not in memo:
            memo[word] = len(lib.encode(tokencount.START + word).ids)
        return memo[word]

    for r in tokencount.token_counts(docs, path).collect():
        words = WORDS.findall(text[r["doc_id"]] or "")
        if all(c in scores for w in words for c in w):
            counted += 1
            assert r["n_tokens"] == sum(map(n_tokens, words))
    assert counted > len(text) / 2


# --- quality


def test_quality_features_are_of_characters():
    at, x = quality.features("ж" * 5)
    assert len(at) == 4 and abs((x**2).sum() - 1) < 1e-9  # one run of each length, and the word


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"same id {i}") for i in range(50)] + [(i, prose(i, 60)) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 9 + [(i, i % 2) for i in range(2, 40)], "doc_id long, quality int")
    from tidemark.llm.common import hashed_sample

    known = labels.selectExpr("doc_id", "quality", "xxhash64(doc_id) as key")
    n = Counter(r["quality"] for r in hashed_sample(known, "quality", "key", 7).collect())
    assert n == {0: 7, 1: 7}
    assert len(quality.score_quality(docs, quality.fit_quality(docs, labels, per_class=7)).collect()) == 88


def test_base_counts():
    for r in awkward_rows():
        assert quality.base_counts(r[1]) == base_counts(r[1])
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("ab \n\té#") for _ in range(rnd.randrange(60)))
        assert quality.base_counts(t) == base_counts(t)


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 2 = 0")
    out = {r["doc_id"]: r for r in quality.score_quality(docs, quality.fit_quality(docs, train)).collect()}
    rest = [r for r in labels.filter("doc_id % 2 = 1").collect() if not out[r["doc_id"]]["base_failed"]]
    assert sum((out[r["doc_id"]]["probability"] >= 0.5) == (r["quality"] == 1) for r in rest) >= 0.9 * len(rest)
    assert all(r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5) for r in out.values())


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.fit_quality(awkward(spark), labels)
    assert model is None
    out = quality.score_quality(awkward(spark), model).collect()
    assert len(out) == len(awkward_rows())
    assert all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.score_quality(empty(spark), None).collect() == []


# --- BPE


def test_bpe_is_the_library(spark):
    lib, path = library("word_bpe_49k.json"), P.path("word_bpe_49k.json")
    rows = awkward_rows()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_digest(awkward(spark), path).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [lib.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    assert got == Counter((r[0], len(i), sha(" ".join(map(str, i))), sha(lib.decode(i, skip_special_tokens=False))) for r, i in zip(rows, ids))
    full = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.bpe_encode(awkward(spark), path).collect())
    assert full == Counter((r[0], tuple(i), lib.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids))
    assert bpe.bpe_digest(empty(spark), path).collect() == []


def test_bpe_random_text():
    lib, own = library("word_bpe_49k.json"), bpe.ForcedBoundaryBpe(P.path("word_bpe_49k.json"), memo=50)
    rnd = random.Random(1)
    letters = [chr(c) for c in range(1, 0x400)] + ["<|endoftext|>", "'s", "  ", "ς", "中", "😀", "é"]
    for i in range(3000):
        t = "".join(rnd.choice(letters if i % 2 else letters[30:128]) for _ in range(rnd.randrange(14)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_long_words():
    lib, own = library("word_bpe_49k.json"), bpe.ForcedBoundaryBpe(P.path("word_bpe_49k.json"))
    rnd = random.Random(6)
    for t in ("ha" * 100_000, "".join(rnd.choice("abcdefgh") for _ in range(60_000)), "é1" * 5000):
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def all_characters():
    """Every assigned character, but for the inner ones of the two largest blocks, and every seventh of the others."""
    for c in range(128, 0x110000):
        if not 0xD800 <= c < 0xE000 and (c % 7 == 0 or c < 0x3400 or (unicodedata.category(chr(c)) != "Cn" and not 0x3500 < c < 0xD700 and not 0x20100 < c < 0x32000 and c < 0xE0200) or 0x16E00 < c < 0x16F00 or 0x18C00 < c < 0x19100):
            yield chr(c)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_character_classes_are_the_library(name):
    lib = library(name)
    split = (bpe.ForcedBoundaryBpe(P.path(name)) if name.startswith("word") else tokenfile.BatchEncoder(P.path(name))).split
    kinds = charclass.stand_ins(lib.pre_tokenizer)
    places = lambda t: [m.span() for m in split.finditer(t.translate(kinds))]
    for c in all_characters():
        t = f"a{c}b1{c}1!{c}'re"
        assert places(t) == [x for _, x in lib.pre_tokenizer.pre_tokenize_str(t)], hex(ord(c))


def test_encoders_on_rare_characters():
    word, own = library("word_bpe_49k.json"), bpe.ForcedBoundaryBpe(P.path("word_bpe_49k.json"))
    byte, enc = library("byte_bpe_50k.json"), tokenfile.BatchEncoder(P.path("byte_bpe_50k.json"))
    some = list(all_characters())
    texts = [form.format("".join(some[i : i + 9])) for i in range(0, len(some), 63) for form in ("x{}y", "{}'re 1", "a {}\n\n z ", "\x00 {} b\nc")]
    for t, w, b, raw in zip(texts, word.encode_batch(texts, add_special_tokens=False), byte.encode_batch(texts, add_special_tokens=False), enc.encode(texts)):
        assert own.encode(t) == w.ids
        assert np.frombuffer(raw, enc.kind).tolist() == b.ids


def test_words_behind_spaces_are_encoded_together():
    path = P.path("byte_bpe_50k.json")
    enc, lib = tokenfile.BatchEncoder(path), library("byte_bpe_50k.json")
    seen = []

    class Counted:
        def encode_batch_fast(self, some, **more):
            seen.extend(some)
            return lib.encode_batch_fast(some, **more)

    enc.lib = Counted()
    texts = [" ".join(f"w{i} été{i},\n日{i}’s {chr(0x1D4B3)}{i} <|endoftext|> \u00a0x{i} e\u0301{i}" for i in range(k, k + 300)) for k in (0, 200)] + ["a  b", " a", "a ", "a\tb c \t d", "", None, "\u2003 x"]
    for t, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, enc.kind).tolist() == lib.encode(t or "", add_special_tokens=False).ids
    seen.clear()
    enc.encode([" ".join(f"un{i} öd{i}," for i in range(300))])
    assert len(seen) == 3  # before, one string for every distinct word


# --- token files


def test_token_files(spark):
    path, lib = P.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    folder = fresh_folder(spark, "test-token-files")
    manifest = tokenfile.write_token_files(awkward(spark), path, folder)
    out = tokenfile.read_token_files(manifest).collect()
    rows = awkward_rows()
    expected = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expected[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == expected
    line = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in line] == [0, *np.cumsum([r["n_tokens"] for r in line])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in line]
    assert ids == sorted(ids)
    found = {r["doc_id"]: r["ids"] for r in tokenfile.lookup(manifest, spark.createDataFrame([(3,), (12,), (77,)], "doc_id long")).collect()}
    assert found == {i: lib.encode(rows[i][1], add_special_tokens=False).ids + [2] for i in (3, 12)}
    # Repeated ids: all their documents; null: the documents without an id; unknown ids: none.
    again = Counter((r["doc_id"], tuple(r["ids"])) for r in tokenfile.lookup(manifest, spark.createDataFrame([(6,), (100,), (100,), (None,), (-5,)], "doc_id long")).collect())
    assert again == Counter((r[0], (*lib.encode(r[1], add_special_tokens=False).ids, 2)) for r in rows if r[0] in (6, 100, None))
    ends = spark.createDataFrame([(i, f"text {i}") for i in (-(2**63), None, 2**63 - 1, 0, None, -(2**63))], "doc_id long, text string")
    manifest = tokenfile.write_token_files(ends, path, folder)
    assert Counter(r["doc_id"] for r in tokenfile.read_token_files(manifest).collect()) == Counter([-(2**63), None, 2**63 - 1, 0, None, -(2**63)])
    assert Counter(r["doc_id"] for r in tokenfile.lookup(manifest, ends.select("doc_id")).collect()) == Counter([-(2**63), None, 2**63 - 1, 0, None, -(2**63)])
    none = tokenfile.write_token_files(empty(spark), path, folder)
    assert tokenfile.lookup(none, ends.select("doc_id")).collect() == []
    assert tokenfile.read_token_files(none).collect() == []


def test_perfect_index():
    ids = np.arange(5000) * 7 - 100
    occ = np.arange(5000) % 3
    index = tokenfile.PerfectIndex.build(ids, occ, ids + 100, np.full(5000, 9))
    again = tokenfile.PerfectIndex.from_bytes(index.to_bytes())
    slots = again.find(ids, occ)
    assert sorted(slots) == list(range(5000)) and (again.offsets[slots].astype(int) == ids + 100).all()
    assert (again.find(ids + 1, occ) == -1).mean() > 0.999


# --- language


def test_segmentations_are_summed():
    seg = langid.Segmenter(["a", "b", "ab", langid.START], np.array([[0.2, 0.3, 0.4, 0.1]]))
    assert np.exp(seg.forward([langid.START + "ab"])[0][0]) == pytest.approx(0.1 * (0.4 + 0.2 * 0.3))
    into = [0.0] * 4
    langid.add_expected("ab", 1.0, seg.index, [0.2, 0.3, 0.4, 0.1], into)
    assert into[:3] == pytest.approx([0.06 / 0.46, 0.06 / 0.46, 0.4 / 0.46])


def test_long_pieces_and_words_are_summed():
    pieces = ["a", "b", "aaaaabbbbb", langid.START]
    assert max(map(len, langid.pieces_at(P.path("piece_bpe_32k.model")))) > 8
    p = np.array([[0.2, 0.3, 0.4, 0.1]])
    seg = langid.Segmenter(pieces, p)
    one = 0.4 + 0.2**5 * 0.3**5
    assert seg.log_likelihoods(["aaaaabbbbb"])[0][0] == pytest.approx(np.log(0.1 * one))
    for times in (4, 900):  # pieces across any cut, and sums far below the smallest number
        assert seg.log_likelihoods(["aaaaabbbbb" * times])[0][0] == pytest.approx(np.log(0.1) + times * np.log(one))
        into = [0.0] * 4
        langid.add_expected("aaaaabbbbb" * times, 1.0, seg.index, p[0].tolist(), into)
        assert into[2] == pytest.approx(times * 0.4 / one)
    assert seg.log_likelihoods(["?" * 500])[0][0] == pytest.approx(np.log(0.1) + 500 * np.log(langid.UNKNOWN))


def test_likelihoods_of_whole_texts(spark):
    """Sums over all segmentations of every word of texts with words of 60 letters, against a plain recursion."""
    rnd = random.Random(8)
    pieces = ["a", "b", "c", "ab", "bca", "abcabc", "cccccccccccc", langid.START, langid.START + "a", langid.START + "bc"]
    probs = np.array([[rnd.random() for _ in pieces] for _ in range(3)])
    probs /= probs.sum(axis=1, keepdims=True)
    texts = [" ".join("".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 3, 7, 60]))) for _ in range(12)) for _ in range(20)] + [None, "12", "é" * 60]

    def word(w, p):
        front = [1.0]
        for end in range(1, len(w) + 1):
            at = sum(front[k] * p[w[k:end]] for k in range(end) if w[k:end] in p)
            front.append(at + (langid.UNKNOWN * front[end - 1] if w[end - 1] not in p else 0))
        return np.log(front[-1])

    seg = langid.Segmenter(pieces, probs)
    for _ in range(2):  # the second time from the memo
        for t, got in zip(texts, seg.of_texts(texts)):
            words = langid.words_of(t)
            if not words:
                assert got is None
            elif t != "é" * 60:  # 1e-9 to the 60th is no double; rescaled sums hold it
                assert got == pytest.approx([sum(word(langid.START + w, dict(zip(pieces, p))) for w in words) for p in probs], rel=1e-9)
            else:
                assert got == pytest.approx([np.log(p[pieces.index(langid.START)]) + 60 * np.log(langid.UNKNOWN) for p in probs], rel=1e-9)


def test_language_pieces_are_searched_for_all_words_at_once():
    pieces = [*langid.pieces_at(P.path("piece_bpe_32k.model")), "\U0001d4b3y", "x\U0001d4b3"]
    trie, prefixes = langid.Trie(pieces), langid.prefixes_of(pieces)
    rng, known = random.Random(5), set(pieces)
    words = [rng.choice(pieces)[: rng.randrange(1, 9)] + rng.choice(pieces + ["?", "\U0010ffff"]) for _ in range(3000)]
    nodes = np.zeros(len(words), np.int64)
    for k in range(1, 9):
        some = np.array([i for i, w in enumerate(words) if len(w) >= k and nodes[i] >= 0])
        nodes[some] = trie.step(nodes[some], np.array([ord(words[i][k - 1]) for i in some]))
        for i in some:
            assert (nodes[i] >= 0) == (words[i][:k] in prefixes)
            assert nodes[i] < 0 or (pieces[trie.piece[nodes[i]]] if trie.piece[nodes[i]] >= 0 else None) == (words[i][:k] if words[i][:k] in known else None)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = langid.language_id(docs, P.path("piece_bpe_32k.model"), per_language=60).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in lang}
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_awkward(spark):
    path = P.path("piece_bpe_32k.model")
    out = langid.language_id(awkward(spark), path, per_language=5).collect()
    assert len(out) == len(awkward_rows())
    by_text = {r["doc_id"]: r for r in out}
    assert all(by_text[i]["lang_pred"] == "und" for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.language_id(empty(spark), path).collect() == []


# --- personal data


def test_personal_data(spark):
    rows = awkward_rows() + [(200, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", None, None, *[None] * 6), (201, "+1 (23) 456-7890) +12 4111-1111-1111-1112 😀é a@b.co", None, None, *[None] * 6), (202, "1" * 30000 + "@", None, None, *[None] * 6)]
    from helpers import SCHEMA

    out = pii.disclosing_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    got = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in out)
    assert got == Counter((r[0], tuple(personal(r[1]))) for r in rows)
    assert pii.disclosing_spans(empty(spark)).collect() == []


def test_disclosing_terms(spark):
    call = "+1 (663) 555-6869"
    texts = [f"please call zanzibar under {call} today number{i} {prose(i, 30)}" for i in range(4)] + [f"please do come today {prose(i, 40)}" for i in range(50, 90)] + ["zanzibar"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.disclosing_spans(docs)
    terms = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in spans.collect() for s in r["terms"]}
    assert {t for _, t in terms} >= {"zanzibar", "under"} and "please" not in {t for _, t in terms} and "today" not in {t for _, t in terms}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, spans).collect()}
    assert clean[0].startswith("please") and "[PHONE]" in clean[0] and "zanzibar" not in clean[0] and call not in clean[0]
    assert clean[10] == texts[10]
    # Copies of one passage disclose nothing.
    same = spark.createDataFrame([(i, f"the only quokka {call}") for i in range(5)] + [(9 + i, prose(i, 20)) for i in range(9)], "doc_id long, text string")
    assert not any(r["terms"] for r in pii.disclosing_spans(same).collect())


def test_terms_anywhere_in_the_text(spark):
    call, mail = "+1 (663) 555-6869", "ann.b@c-d.org"
    far = lambda i: " ".join(f"plain{i % 3} filler" for _ in range(12))
    texts = [f"Zanzibar {far(i)} odd{i} {call} even{i} {far(i)} zanzibar, and Zo R2D2 {'x' * 50}." for i in range(3)]
    texts += [f"{mail} {far(i)} common {far(i + 1)}" for i in range(3)] + [f"common {far(i)} and words {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.disclosing_spans(docs)
    places = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]] for r in spans.collect()}
    for i in range(3):
        assert places[i] == ["Zanzibar", "zanzibar", "Zo", "R2D2", "x" * 50]
    assert not any(places[i] for i in range(3, len(texts)))
    assert "zanzibar" not in pii.sanitised(docs, spans).first()["text"].lower()


def test_terms_of_rare_entities(spark):
    rest = [(100 + i, f"common {prose(i, 20)}") for i in range(40)]
    # The same surroundings in different texts, and copies of them: the term stands beside the number in two texts.
    alike = [f"{prose(70 + i, 30)} {'-' * 64} quokka +1 (663) 555-6869 {'-' * 64} {prose(80 + i, 30)}" for i in (0, 1, 1, 1)]
    # Every address and number stands in one text only; the domain and the block tell.
    kin = [f"{prose(90, 9)}{i} ask ax{i}.b{i}@wombat.example from acme" for i in range(3)] + [f"vole{i} numbat +1 (755) 555-379{i}" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(alike)) + [(10 + i, x) for i, x in enumerate(kin)] + rest, "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: {text[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]} for r in pii.disclosing_spans(docs).collect()}
    assert all("quokka" in got[i] for i in range(4))
    assert all("acme" in got[10 + i] and "numbat" in got[13 + i] and f"vole{i}" not in got[13 + i] for i in range(3))
    assert not any(got[i] for i, _ in rest)


def test_secrets(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    shown = "A1b2C3d4E5f6G7h8J9k0"
    rows = [(1, f'token = "{key}" é'), (2, "plainwordsonlyofletters 12345678901234567890 aaaaaaaaaaaaaaaaaaa1"), (3, f"{key}x@host.org"), (4, None)] + [(10 + i, f"{prose(i, 5)} {shown}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.disclosing_spans(docs)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"]] for r in spans.collect()}
    assert got[1] == [(9, 49)] and not any(got[i] for i in got if i != 1)  # what nine texts show is no secret
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, spans).collect()}
    assert clean[1] == 'token = "[SECRET]" é' and clean[3] == "[EMAIL]" and clean[2] == rows[1][1] and clean[4] is None


def test_many_spans_in_one_text(spark):
    from time import time

    text = " ".join(f"é a{i}@b{i}.org 10.0.{i % 256}.7" for i in range(8000))
    docs = spark.createDataFrame([(1, text), (2, text[:90])], "doc_id long, text string")
    began = time()
    spans = pii.disclosing_spans(docs)
    got = {r["doc_id"]: r for r in spans.collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]["base"]] == personal(text)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, spans).collect()}
    assert clean[1].count("[EMAIL]") == 8000 and clean[1].count("[IP]") == 8000 and "@" not in clean[1]
    assert time() - began < 120


# --- Jaccard join


def near_texts():
    rnd, texts = random.Random(9), []
    for g in range(12):
        words = prose(100 + g, rnd.choice([4, 6, 30, 90, 150]), 5000).split(" ")
        for _ in range(rnd.randrange(1, 7)):
            w = list(words)
            for _ in range(rnd.randrange(0, 1 + len(w) // 20)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(9)}"
            texts.append(" ".join(w))
    passage = prose(77, 60, 5000)
    return texts + [f"{prose(200 + i, 20, 9000)} {passage} {prose(300 + i, 15, 9000)}" for i in range(15)]


@pytest.mark.parametrize(("region", "levels"), [(4096, 3), (4, 3), (4, 0)])
def test_jaccard_components(spark, region, levels):
    rows = [(i, t) for i, t in enumerate(near_texts())] + [(500 + r[0], r[1]) for r in awkward_rows() if r[0] is not None]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[0][1], "x", 1)], "doc_id long, text string, component string, n int")
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t))
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    comp = smallest_reachable(sets, linked)
    out = jaccard.jaccard_components(df, region=region, levels=levels).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == Counter([(i, len(shingles(t)), comp[i]) for i, t in rows] + [(None, len(shingles(rows[0][1])), None)])


def test_rings_around_pivots(spark):
    """Linked documents of one large region meet, at every distance from the pivot; copies of the pivot are not compared with each other."""
    rnd, base = random.Random(4), prose(5, 200, 9000).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for p in rnd.sample(range(200), rnd.randrange(0, 60)):
            w[p] = f"q{i % 7}x{p}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    region = spark.createDataFrame([(7, i, len(sets[i]), 0, i) for i in sets], "g long, doc_id long, n int, pos int, comp long")
    for levels in (0, 1, 3):
        got = {(r["a"], r["b"]) for r in jaccard.ring_pairs(region, docs, 5, 80, 4, levels).distinct().collect()}
        assert links <= got
    one = region.withColumn("comp", F.lit(1).cast("long"))
    assert jaccard.ring_pairs(one, docs, 5, 80, 4, 3).count() == 0


def test_sketches_never_refuse_a_link():
    rng = np.random.default_rng(1)
    some = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(some(n)) for n in (1, 3, 100, 120, 300, 330, 1000, 2000, 5000, 20000)]
    sets += [np.unique(np.concatenate([s[len(s) // 10 :], some(len(s) // 9)])) for s in sets]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    sketches = jaccard.Sketches([jaccard.sketch(s) for s in sets] + [None])
    assert sketches.may_link(a, b, apart).all()
    n = np.array([len(s) for s in sets])
    strangers = (a % 10 != b % 10) & (np.maximum(n[a], n[b]) <= 2000) & (np.minimum(n[a], n[b]) >= 100) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
    assert strangers.sum() >= 8
    assert not sketches.may_link(a, b, (n[a] + n[b]) // 9)[strangers].any()
    assert sketches.may_link(np.array([0]), np.array([len(sets)]), np.array([0])).all()  # an unknown set is never refused


def test_sketches_spare_pairs(spark):
    """Documents that share a passage and little else meet in its regions, and are refused before a pair is written."""
    passage = prose(77, 60, 5000)
    docs = spark.createDataFrame([(i, f"{prose(200 + i, 80, 9000)} {passage} {prose(300 + i, 60, 9000)}") for i in range(60)], "doc_id long, text string")
    rows = jaccard.shared_regions(jaccard.region_rows(docs, jaccard.NONE, 5, 80)).withColumn("comp", F.col("doc_id"))
    known = rows.join(jaccard.signatures(docs, 5).select("doc_id", "sketch"), "doc_id")
    assert jaccard.candidate_pairs(rows.withColumn("sketch", F.lit(None).cast("binary")), docs, 5, 80).count() > 100
    assert jaccard.candidate_pairs(known, docs, 5, 80).count() == 0


def test_a_dense_group_is_thinned(spark, monkeypatch):
    """Of near copies of which none links with all, a few pairs each are compared and not all of them; the groups are those of all pairs."""
    rnd, base, rows = random.Random(6), prose(8, 200, 9000).split(" "), []
    for i in range(90):
        w = list(base)
        for p in rnd.sample(range(5, 195), 4 if i % 9 == 0 else 2):
            w[p] = f"q{i}x{p}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    seen, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == smallest_reachable(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert sum(seen) < 1500, seen


def test_components_carry_no_estimate_of_size(spark):
    """Before, the planner's estimate was a product over all rounds: some ten of them made planning endless."""
    comps = graph.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    assert comps.select("component").distinct().count() == 1
    assert len(str(comps._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 30


def test_components_that_do_not_close(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), max_rounds=1)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 5), (None, 3)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_shards_follow_linked_groups(spark):
    texts = ["a"] * 10 + ["b"] * 10 + [f"single {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (docs.filter(f"text = '{t}'").selectExpr("xxhash64(text) as h").first()["h"] for t in "ab")
    edges = spark.createDataFrame([(a, b), (b, a)], "a long, b long")
    rows = sharding.shard_documents(docs, n_shards=4, edges=edges, rounds=6).collect()
    check_shards(rows, texts, 4)
    assert len({r["shard"] for r in rows if r["doc_id"] < 20}) == 1


def test_words_of_a_batch_are_counted_and_encoded_together():
    """Each distinct word of a batch is worked on once, with the same results as text by text."""
    import pyarrow as pa

    rng = random.Random(5)
    some = ["Anble", "anble###", "erhaé,", "über", "a", "a\x00", "a\x00b", "\u4e2d\u6587", "\U0001f600x", "ß'll", "I'm", "x" * 70, "1234", "don't.", "...", "<|endoftext|>", "\xa0y", "e\u0301"]
    texts = [rng.choice(" \n").join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "  two  spaces ", "\ttab\r\n", "line\n\nline", "\u2003wide\u2003", "\x1cx\x1fy"]
    column = pa.array(texts * 3)
    counter = tokencount.TrieCounter(*tokencount.zipf_pieces(P.path("piece_bpe_32k.model")), memo=9)
    asked, grown = [], counter.grown
    counter.grown = lambda words: (asked.extend(words), grown(words))[1]
    words, tokens = counter.of_column(column)
    assert list(zip(words.tolist(), tokens.tolist())) == counter.of_texts(texts * 3)
    assert asked and len(asked) == len(set(asked))
    enc, lib = tokenfile.BatchEncoder(P.path("byte_bpe_50k.json"), memo=9), library("byte_bpe_50k.json")
    assert enc.encode_column(column) == [enc.raw(lib.encode(t or "", add_special_tokens=False).ids) for t in texts * 3]
    own, lib = bpe.ForcedBoundaryBpe(P.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    n, ids, decoded = own.columns(texts * 3)
    for t, k, i, d in zip(texts * 3, n.tolist(), ids.to_pylist(), decoded.to_pylist()):
        right = lib.encode(t or "", add_special_tokens=False).ids
        assert (k, i, d) == (len(right), " ".join(map(str, right)), lib.decode(right, skip_special_tokens=False)), t
