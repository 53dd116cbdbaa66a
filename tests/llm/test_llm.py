"""Operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import gzip
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

tokens = pytest.importorskip("public_tokenizers")

from sievespark.llm import bpe, langid, license_scan, line_dedup, near_dup, packing, quality_mil, quality_rules, simhash, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, score double, n_words long, pid int"
WORDS = [a + b for a in ("al", "be", "co", "du", "en", "fi") for b in ("ra", "st", "ti", "um", "on", "er")]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    common = "this line is shared by very many documents"
    out = [None, "", " ", "A.", "one two three", "\n\n", common, "é" * 30, "word " * 4000, "x" * 900]
    while len(out) < n:
        text = "\n".join([line(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))] + [common] * rng.randint(0, 2))
        out += [text, text.replace("al", "AL", 1), text + " end"][: rng.randint(1, 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("aa", "bb", None)[i % 3], 0.5, 1, 2) for i, t in enumerate(texts())]
    rows += [rows[20], (None, "no id here at all", "aa", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_langid(spark, docs, none):
    profile = langid.train(docs)
    rows = langid.identify(docs, profile).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows)
    two = spark.createDataFrame([(i, "the cat and the dog ran" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred for r in langid.identify(two, langid.train(two)).collect())
    assert langid.identify(none, profile).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_license_scan(spark, docs, none):
    notice = license_scan.TEMPLATES["mit-grant"]
    df = spark.createDataFrame([(1, "some text\n" + notice.upper()), (2, "Released under the MIT License!"), (3, "released under another licence"), (4, None), (5, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.line_no, r.license, r.dice) for r in license_scan.scan(df).collect()}
    assert (1, 1, "mit-grant", 1.0) in rows and (2, 0, "mit", 1.0) in rows and {r[0] for r in rows} == {1, 2}
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(none).count() == 0


def test_license_scan_full_texts_and_wrapped_notices(spark):
    known = license_scan.all_templates()
    code = "\n".join(f"x{i} = compute({i}, value)" for i in range(30))
    wrapped = textwrap.fill(license_scan.TEMPLATES["mit-grant"], 76)
    cases = [known["mit-text"], wrapped + "\n" + code, code.replace("\n", " ") + " " + known["isc-text"].replace("\n", " ") + code, code + "\n# " + wrapped.replace("\n", "\n# ") + "\n" + code + "\n" + wrapped]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.line_no, r.license) for r in rows if r.dice == 1.0)
    n = len(wrapped.split("\n"))
    assert got == Counter([(0, -1, "mit-text"), (0, 4, "mit-grant"), (1, 0, "mit-grant"), (2, 0, "isc-text"), (2, 0, "isc-grant"), (3, 30, "mit-grant"), (3, 60 + n, "mit-grant")])


def test_license_windows_equal_brute_force(spark):
    rng = random.Random(9)
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    notice = [rng.choice("abcdefgh") for _ in range(14)]
    most = math.ceil(13 * 1.5)
    cases = [[x for w in notice for x in rng.choice([[w]] * 8 + [[], [w, "z"], ["y"]])] for _ in range(80)]
    cases = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] + c + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for c in cases]
    expected = {}
    for i, w in enumerate(cases):
        best = max(dice(pairs(w[a:b]), pairs(notice)) for a in range(len(w)) for b in range(a + 2, min(len(w), a + 1 + most) + 1))
        if best >= 0.8:
            expected[i] = best
    got = {}
    for r in license_scan.scan(spark.createDataFrame([(i, "\n".join(w)) for i, w in enumerate(cases)], "doc_id long, text string"), {"own": " ".join(notice)}).collect():
        if r.line_no >= 0:
            got[r.doc_id] = max(r.dice, got.get(r.doc_id, 0))
        else:
            expected.pop(r.doc_id)
    assert got == pytest.approx(expected) and len(expected) > 10


def best_fit(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= x), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(capacity - x)
        else:
            bins[fit] -= x
    return sorted(bins)


def test_best_fit_equals_item_by_item():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([1, 10, 37, 64])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        counts = Counter(items)
        runs, n = packing.best_fit_decreasing(counts, capacity)
        length, rank = np.array([k for k, c in counts.items() for _ in range(c)], np.int64), np.array([r for c in counts.values() for r in range(c)], np.int64)
        where, offset = packing.place(runs, length, rank, capacity) if items else (length, length)
        room = [capacity] * n
        for k in range(n):
            at = 0
            for o, size in sorted(zip(offset[where == k], length[where == k], strict=True)):
                assert o == at
                at += size
            room[k] -= at
        assert sorted(room) == best_fit(items, capacity)


def test_packing(spark, docs, none):
    path = tokens.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, 128).toPandas()
    whole = packing.WordTokens(path)
    expected = Counter()
    for r in docs.collect():
        ids = whole.whole(r.text or "") + b"\x01\0\0\0"
        for k, i in enumerate(range(0, len(ids), 512)):
            expected[r.doc_id, k, i // 4, len(ids[i : i + 512]) // 4, zlib.crc32(ids[i : i + 512])] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == expected
    assert rows.sequence_id.nunique() == len(best_fit(rows.length.tolist(), 128))
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate(([0], own.length.cumsum()[:-1])).tolist() and own.length.sum() <= 128
    assert packing.pack_documents(none, path).count() == 0


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = packing.WordTokens(tokens.path("word_bpe_49k.json"))
    odd = ["", "it's 'S don't", "ÀÉ ß 12.5%$ <|endoftext|> a</w> x­ y·z", "İı", "x" * 100, "日本", "a\x1cb\x0bc\xa0d", "éa", "   ", "it'S O'REILLY's"]
    library = Tokenizer.from_file(tokens.path("word_bpe_49k.json"))
    odd += ["see <|endoftext|> here", "<|startoftext|>x", "<|ENDOFTEXT|>", "<|endoftext|"]
    rng = random.Random(12)
    bits = [*"abzEST019 \t\n.,'!?-#$%&|<>()", "'s", "'LL", "the ", "ing", "é", "Ü", "ñ", "–", "’", "e\u0301", "ﬁ", "漢", "😀", "\xa0", "\u2028", "<|endoftext|>", "  "]
    odd += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    ids = lambda x: np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert t.encode([x.encode() for x in odd]) == [ids(x) for x in odd]
    assert np.frombuffer(ids("see <|endoftext|> here"), "<u4")[1] == 49407


def test_other_tokenizers_go_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, " ": 3}, [("a", "b")]))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    t = packing.WordTokens(str(tmp_path / "t.json"))
    assert not t.by_words and np.frombuffer(t.encode([b"ab ba", None])[0], "<u4").tolist() == [2, 1, 0]


def test_quality_classifier(spark, none):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 300)))
    rows = [(i, good() if i % 2 else good().replace(" ", "%%% "), i % 2) for i in range(300)]
    df = spark.createDataFrame([*rows, (998, None, 1), (999, "", 0)], "doc_id long, text string, quality int")
    model = quality_mil.train(df.select("doc_id", "text"), df.where("doc_id < 200").select("doc_id", "quality"), epochs=25)
    out = {r.doc_id: r for r in quality_mil.score(df, model).collect()}
    assert all(out[i].predicted == i % 2 for i in range(200, 300)) and 0 <= out[998].score == out[999].score <= 1
    assert quality_mil.score(none, model).count() == 0
    assert quality_mil.score(df, quality_mil.train(df, df.limit(0))).first().score == 0.5


def test_quality_classifier_gradients():
    rng = np.random.default_rng(3)
    bags = quality_mil.passages([t.encode() if t else t for t in texts(12)])
    model, labels = quality_mil.Attention(quality_mil.FEATURES, 1), rng.integers(0, 2, len(bags.bounds) - 1).astype(float)
    model.p = {k: v + 0.1 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    loss = lambda: -np.mean(np.log(np.where(labels > 0, y := model.forward(bags)["y"], 1 - y)))  # noqa: E731, F821
    for name, g in model.gradients(bags, labels).items():
        used = np.argsort(-np.abs(g).ravel())[:5]
        for i in used:
            at, keep = np.unravel_index(i, g.shape), model.p[name].copy()
            model.p[name][at] = keep[at] + 1e-6
            up = loss()
            model.p[name][at] = keep[at] - 1e-6
            assert g[at] == pytest.approx((up - loss()) / 2e-6, rel=1e-4, abs=1e-8)
            model.p[name] = keep


def test_quality_classifier_scores_equal_texts_alike(spark, docs):
    """In any place of any partitioning, to the last bit; whole documents are learnt from."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality_mil.train(docs, labels, epochs=2)
    own = docs.select("doc_id", "text")
    many = own.union(own).union(own.where("doc_id > 30"))
    by_text: dict = {}
    for df in (many.repartition(1), many.repartition(7), own.orderBy(own.doc_id.desc()).coalesce(1)):
        for r in quality_mil.score(df, model).collect():
            by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values()) and len(set.union(*by_text.values())) > 20
    long = [t for t in texts() if t and len(t) > 15_000]
    sample = quality_mil.training_sample(docs, labels, None, 100, 1 << 20)
    assert {t for t, _ in sample} >= {t.encode() for t in long}
    small = quality_mil.training_sample(docs, labels, None, 100, 5_000)
    assert 0 < sum(len(t) for t, _ in small) <= 5_000 and {t for t, _ in small} <= {t for t, _ in sample}


def test_quality_rules(spark, docs, none):
    ratios = quality_rules.fit(docs, docs.where("doc_id > 10"))
    rows = quality_rules.judge(docs, ratios).collect()
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows, cover = {}, set()
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), []).append(k)
        for at in windows.values():
            if len(at) > 1:
                cover.update(j for k in at for j in range(k, k + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(words) < 20 or 100 * len(cover) > 30 * len(words)) and not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    raw, target = np.full(quality_rules.BUCKETS, 1.0), np.full(quality_rules.BUCKETS, 1.0)
    for r in docs.collect():
        data = (r.text or "").encode()
        for k in range(len(data) - 3):
            b = (int.from_bytes(data[k : k + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 18
            raw[b] += 1
            target[b] += (r.doc_id or 0) > 10
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    assert quality_rules.judge(none, quality_rules.fit(none, none)).count() == 0


def test_quality_rules_count_every_trusted_document(spark):
    many = spark.range(25_000).selectExpr("id AS doc_id", "sha2(string(id), 256) AS text")
    trusted = many.select("doc_id").union(many.select("doc_id").limit(9)).union(spark.sql("SELECT bigint(null)"))
    assert not quality_rules.fit(many, trusted).any()
    assert quality_rules.fit(many.union(spark.sql("SELECT bigint(null), repeat('no id ', 99)")), trusted).any()


def deduped(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n") if len(key(x)) >= 20}:
            held.setdefault(k, []).append((-(1 << 63), n) if i is None else (i, 0))
    gone = {k: max(v)[0] for k, v in held.items() if len(set(v)) >= 3}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if gone.get(key(x), i) == i]
        out[i, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    return out


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_line_dedup(docs, none, limit):
    expected = deduped([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(docs, broadcast_bytes=limit).collect())
    assert got == expected and sum(k[2] for k in got) > 0
    assert line_dedup.dedup_lines(none, broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_line_dedup_counts_documents(spark, limit):
    """Rows of one id are one document; each row without an id is one."""
    a, b, c = (x * 30 for x in "abc")
    rows = [(1, a), (1, a), (2, a), (1, a + "\n" + b), (2, b), (3, b), (None, c), (None, c), (None, c + "\nown"), (4, c + "\n" + c), (None, b)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=limit).collect())
    assert got == deduped(rows) and (1, 1, 0, a) in got and (4, 2, 0, c + "\n" + c) in got and (None, 2, 1, "own") in got


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert sorted(line_dedup.PerfectHash(keys).find(keys).tolist()) == list(range(len(keys)))


def test_simhash(spark, docs, none):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    ids, all_texts = [r[1] if r[0] else None for r in rows], [r[3] for r in rows]
    mark = lambda t: simhash.fingerprints([t.encode()])[0]
    expected = Counter()
    for k, t in enumerate(all_texts):
        after, half = all_texts[(k + 1) % len(rows)], len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        expected[ids[k], len(t), hashlib.sha256(edit.encode()).hexdigest(), mark(t).tobytes().hex(), mark(edit).tobytes().hex(), float(simhash.likeness(mark(t), mark(edit))), float(simhash.likeness(mark(t), mark(after)))] += 1
    assert Counter(tuple(r) for r in simhash.edit_likeness(docs).collect()) == expected
    assert simhash.edit_likeness(none).count() == 0


def test_near_fingerprints(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(128) for _ in range(40)}
    for v in list(values)[:20]:
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 5))))
    hexes = sorted(f"{v:032x}" for v in values)
    expected = {(a, b, d) for i, a in enumerate(hexes) for b in hexes[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    got = simhash.near_fingerprints(spark.createDataFrame([(h,) for h in hexes + hexes[:3]], "fingerprint string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected) and expected


@pytest.mark.parametrize(("radius", "blocks", "members"), [(3, 4, 4096), (3, 4, 5), (5, 7, 3), (0, 1, 4096)])
def test_near_counts(spark, radius, blocks, members):
    """Against all pairs, with keys that many share, cut into parts."""
    rng = random.Random(3)
    base = rng.getrandbits(128)
    values = [rng.getrandbits(128) for _ in range(30)] + [base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 5))) for _ in range(90)] + [0, 0, (1 << 128) - 1, 1 << 127]
    rows = [(i if i % 7 else None, f"{v:032x}") for i, v in enumerate(values)] + [(200, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3)
    got = {r.fingerprint: (r.copies, r.n_near) for r in simhash.near_counts(df, df.doc_id % 3 == 0, radius, blocks, members).collect()}
    expected = {}
    for i, h in rows:
        if h and i is not None and i % 3 == 0:
            expected[h] = (sum(x == h and k is not None and k % 3 == 0 for k, x in rows), sum((int(h, 16) ^ int(x, 16)).bit_count() <= radius for _, x in rows if x))
    assert got == expected


def test_simhash_query(docs, none):
    rows = simhash.edits_and_neighbours(docs, 4).collect()
    assert Counter(tuple(r)[:-1] for r in rows) == Counter(tuple(r) for r in simhash.edit_likeness(docs).collect())
    for r in rows:
        asks = r.doc_id is not None and r.doc_id % 4 == 0
        assert r.n_near == (sum((int(r.fingerprint, 16) ^ int(x.fingerprint, 16)).bit_count() <= 3 for x in rows) if asks else None)
    assert simhash.edits_and_neighbours(none).count() == 0


def test_fingerprint_bits():
    """Votes counted one by one, over hashes worked out in plain whole numbers."""
    top = (1 << 64) - 1

    def mix(x):
        for shift, k in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93), (32, 1)):
            x = ((x ^ x >> shift) * k) & top
        return x

    def word_hash(w):
        parts = [int.from_bytes(w[k : k + 8], "little") for k in range(0, len(w), 8)]
        h = mix(parts[0] ^ (len(w) * 0x9E3779B97F4A7C15 & top))
        for p in parts[1:]:
            h = mix((h * 0x9FB21C651E98DF25 + p) & top)
        return h

    def run_hash(hashes):
        h = 0
        for x in hashes:
            h = (h * 0x9E3779B97F4A7C15 + x) & top
            h ^= h >> 29
        return mix((h + len(hashes)) & top)

    for text in [t for t in texts() if t and len(t) < 3000]:
        data = text.encode().lower()
        words = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
        terms = Counter(words + ([run_hash(words[k : k + 2]) for k in range(max(1, len(words) - 1))] if words else []))
        votes = np.zeros(128)
        for term, n in terms.items():
            bits = mix(term).to_bytes(8, "little") + mix(term ^ 0xA0761D6478BD642F).to_bytes(8, "little")
            signs = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(float) * 2 - 1
            votes += np.float32(1 + math.log(n)) * signs
        sure = np.abs(votes) > 0.01  # a tie leaves a bit unset
        own = np.unpackbits(simhash.fingerprints([text.encode()])[0])
        assert (own[sure] == (votes > 0)[sure]).all() and not own[~sure].any()


def test_bpe(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    odd = ["a   b", "\n \n", "a \nb ", "  x", " a  ", "tab\t b", "\xa0x   y", "日本語 🎉 ok", "ab" * 300 + " c", "'s don't'll", "x\r\n y\n\n\nz"]
    odd += ["".join(rng.choice(" ab\n\t.1é'日") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    codec = bpe.Codec(path, tokens.PATTERN)
    coded = codec.encode([x.encode() for x in odd])
    for x, ids, decoded in zip(odd, coded, codec.decode([bpe.ids_of(c) for c in coded]), strict=True):
        assert ids.decode() == ",".join(map(str, library.encode_ordinary(x))) and decoded == x.encode()
    rows = bpe.decode(bpe.encode(docs, path, tokens.PATTERN), path, tokens.PATTERN).collect()
    assert all(r.tokens == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.digests(none, path, tokens.PATTERN).count() == 0


def test_bpe_long_words_and_other_patterns():
    """Words of thousands of bytes, in bounded rounds and with every pair alone or not; a pattern that can't be cut at spaces."""
    tiktoken = pytest.importorskip("tiktoken")
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    long = ["x" * 5001, "ab" * 3000, "日本語" * 700, "aaab" * 900, "é" * 301]
    long += ["".join(rng.choice(a) for _ in range(rng.randint(65, 2500))) for a in ("ab", "esti", "abcdefghijklmnopqrstuvwxyz", "inginterationed", "日本語中国")]
    codec = bpe.Codec(path, tokens.PATTERN)
    assert [c.decode() for c in codec.encode([x.encode() for x in long])] == [",".join(map(str, library.encode_ordinary(x))) for x in long]
    pattern = r"\w+ \w+|[\s\S]"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    cases = ["one two three", "a  b c", "x", " "]
    assert [c.decode() for c in bpe.Codec(path, pattern).encode([x.encode() for x in cases])] == [",".join(map(str, other.encode_ordinary(x))) for x in cases]


def test_bpe_memory_is_bounded():
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, tokens.PATTERN)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=240)) for _ in range(1_200)]
    assert codec.decode([bpe.ids_of(c.encode()) for c in codec.contract(words)]) == [w.encode() for w in words]


def test_warc(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b b", "small"), (4, "http://c", "small"), (5, "u", None), (6, "u", ""), (None, "n", big), (2, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages, archive_bytes=500)
    got = Counter((r.record_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(archives).collect())
    n = len(big.encode())
    assert got == Counter({("urn:x-page:1", "revisit", n, "urn:x-page:2"): 1, ("urn:x-page:2", "response", n, None): 2, ("urn:x-page:", "revisit", n, "urn:x-page:2"): 1, ("urn:x-page:3", "response", 5, None): 1, ("urn:x-page:4", "response", 5, None): 1, ("urn:x-page:5", "response", 0, None): 1, ("urn:x-page:6", "response", 0, None): 1})
    content = bytes(archives.first().content)
    with pytest.raises(Exception):
        list(warc.records(content[:-4]))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def standard_archive(gzipped=True, together=False):
    """As another writer makes it: warcinfo, request, a response without a payload digest, a revisit without Refers-To, metadata."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello"
    sha = "sha1:" + hashlib.sha1(b"hello").hexdigest().upper()
    made = [
        (["WARC-Type: warcinfo", "WARC-Filename: x.warc.gz", "Content-Type: application/warc-fields"], b"software: own\r\nformat: WARC\r\n\r\n"),
        (["warc-type: request", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        (["WARC-Type: response", "WARC-Target-URI: http://a/", "X-Long: one", "\ttwo", "Content-Type: application/http;msgtype=response"], http),
        (["WARC-Type: revisit", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: {sha}", "Content-Type: application/http; msgtype=response"], b"HTTP/1.1 304 Not Modified\r\nContent-Length: 5\r\n\r\n"),
        (["WARC-Type: metadata", "WARC-Payload-Digest: md5:abc", "Content-Type: application/warc-fields"], b""),
    ]
    out = []
    for k, (head, block) in enumerate(made):
        lines = ["WARC/1.0", *head, f"WARC-Record-ID: <urn:uuid:{k}>", f"Content-Length: {len(block)}"]
        out.append("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n")
    if together:
        out = [b"".join(out)]
    return [gzip.compress(r) if gzipped else r for r in out]


@pytest.mark.parametrize(("gzipped", "together"), [(True, False), (True, True), (False, True)])
def test_warc_reads_standard_archives(spark, gzipped, together):
    df = spark.createDataFrame([("x", bytearray(b"".join(standard_archive(gzipped, together)))), ("none", None), ("empty", bytearray())], "archive string, content binary")
    rows = {r.record_id: r for r in warc.read_archives(df).collect()}
    sha = hashlib.sha1(b"hello").hexdigest()
    assert [rows[f"urn:uuid:{k}"].record_type for k in range(5)] == ["warcinfo", "request", "response", "revisit", "metadata"] and len(rows) == 5
    two, three = rows["urn:uuid:2"], rows["urn:uuid:3"]
    assert (two.payload_bytes, two.payload_digest, bytes(two.payload)) == (5, sha, b"hello")
    assert (three.payload_bytes, three.payload_digest, three.refers_to, three.payload) == (5, sha, None, None)
    assert rows["urn:uuid:4"].payload_digest == hashlib.sha1(b"").hexdigest() and rows["urn:uuid:0"].payload_bytes == 31


def test_warc_damage(spark):
    parts = standard_archive()
    wrong = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
    broken = parts[1][:20] + b"\xff\xff\xff" + parts[1][23:]
    cut = parts[4][:40]
    digest = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 1\r\nWARC-Block-Digest: sha1:" + b"0" * 40 + b"\r\n\r\nx\r\n\r\n")
    df = spark.createDataFrame([("x", bytearray(b"".join([parts[0], wrong, broken, digest, gzip.compress(b"no record at all\r\n\r\n"), parts[2], cut])))], "archive string, content binary")
    with pytest.raises(Exception):
        warc.read_archives(df).collect()
    rows = warc.read_archives(df, damaged="report").collect()
    assert Counter(r.record_type for r in rows) == Counter({"warcinfo": 1, "response": 1, "damaged": 5})
    assert all(r.target_uri for r in rows if r.record_type == "damaged")


def components(rows, size):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_near_dup(docs, none):
    expected = components([(r.doc_id, r.text) for r in docs.collect()], 4)
    got = near_dup.near_duplicates(docs, 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(none).count() == 0


def test_near_dup_large_buckets(spark, monkeypatch):
    """Near copies about the threshold in buckets that are cut into blocks and cells."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(11)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 10)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(k)
        rows.append((k, " ".join(words), None, None, None, None))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 4).collect()
    expected = components([(r[0], r[1]) for r in rows], 4)
    assert 1 < len({c for _, _, c in expected}) < 150
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def judged(rows, trusted):
    """Whether the quality rules keep each text of ``rows`` (id, text), worked out gram by gram."""
    grams = lambda t: [(int.from_bytes(d[k : k + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 18 for d in [(t or "").encode()] for k in range(len(d) - 3)]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n, m = sum(raw.values()) + quality_rules.BUCKETS, sum(target.values()) + quality_rules.BUCKETS
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        own = grams(t)
        score = sum(math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in own) / max(1, len(own)) if target else 0
        out.append(len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and score >= quality_rules.THRESHOLD)
    return out


def identified(rows, training):
    """Language and cosine of each text, by plain sums of bound letter vectors; ``training``: (text, language) of the rows that are learnt from."""
    letter = lambda c: np.random.default_rng([1, ord(c)]).integers(0, 2, langid.DIMENSIONS, np.int8).astype(int) * 2 - 1
    known = {}

    def vector(text):
        t = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
        out = np.zeros(langid.DIMENSIONS)
        for k in range(len(t) - 2):
            if t[k : k + 3] not in known:
                a, b, c = map(letter, t[k : k + 3])
                known[t[k : k + 3]] = np.roll(a, 2) * np.roll(b, 1) * c
            out += known[t[k : k + 3]]
        return out if t.strip() else None

    sums = {}
    for text, lang in training:
        if lang and text and (v := vector(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    out = []
    for text in rows:
        v = vector(text)
        cosines = {lang: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for lang, p in sums.items()} if v is not None else {}
        best = min(cosines, key=lambda k: (-cosines[k], k), default="und")
        out.append((best, cosines.get(best, 0.0)))
    return out


def test_langid_equals_plain_sums(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[k % 3 :: 3] + ["Éa", "x1y", "ß"]) for _ in range(rng.randint(1, 60))), ("aa", "bb", "cc", None)[k % 4]) for i, k in enumerate(rng.choices(range(12), k=60))]
    rows += [(100, None, "aa"), (101, "12 _ 3", "bb"), (102, "", None), (103, "日本", "cc"), (None, "alra best", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    expected = identified([r[1] for r in rows], [(r[1], r[2]) for r in rows if r[0] is not None and r[0] % 2])
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df, df.doc_id % 2 == 1)).collect()}
    assert [got[r[0]].lang_pred for r in rows] == [e[0] for e in expected]
    assert [got[r[0]].score for r in rows] == pytest.approx([min(1, max(0, e[1])) for e in expected], abs=1e-5)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stage by stage, each on all that the stage before it kept: nulls, repeated ids and rows, and columns that clash with the stages' own."""
    import corpus_pipeline

    rng = random.Random(21)
    common = "a line that many of these documents have in common"
    rows = []
    for i in range(90):
        text = "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 4)))
        rows += [(i, text), (i, text + "\n" + common), (None, text + " fin"), (i + 500, text.upper()), (i, text)][: rng.choice([1, 2, 2, 2, 3, 5])]
    rows += [(900, None), (None, None), (901, ""), (902, "0123 456 " * 20), (903, "one two"), (904, ("al be co du " * 9 + "\n") * 3), (None, common), (905, " ".join(WORDS * 300))]
    fields = ("score", "kept", "gone_id", "gone_row", "row_key", "carried_row", "n_lines", "lang_pred", "node", "component_id", "n_chars")
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{f} long" for f in fields)
    full = [(i, t, ("en", "de")[k % 2], *range(k, k + len(fields))) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    trusted = set(range(0, 90, 2))
    spark.createDataFrame([(i, int(i in trusted), 0) for i in range(90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in made.collect()]
        texts_before = [r[1] for r in before]
        if name == "quality_rules":
            assert Counter(after) == Counter(r for r, keep in zip(before, judged([r[:2] for r in before], trusted), strict=True) if keep) and 0 < len(after) < len(before)
        elif name == "language_id":
            found = identified(texts_before, [(r[1], r[2]) for r in before])
            assert Counter(after) == Counter(r for r, (lang, cosine) in zip(before, found, strict=True) if lang != "und" and cosine >= corpus_pipeline.LEAST_COSINE)
        elif name == "line_dedup":
            expected = Counter((i, kept) for (i, _, _, kept), n in deduped([r[:2] for r in before]).items() for _ in range(n))
            assert Counter((r[0], r[1]) for r in after) == expected and all(r[-1] == len(r[1]) for r in after) and Counter(r[2:-1] for r in after) == Counter(r[2:-1] for r in before)
            assert sum(len(t) for t in texts_before) > sum(len(r[1]) for r in after)
        elif name == "minhash_near_dedup":
            groups = near_groups([r[1] for r in before])
            assert not Counter(after) - Counter(before) and len(after) == len(groups) < len(before)
            left = Counter(after)
            for group in groups:
                ids = [before[k][0] for k in group]
                least = min((i for i in ids if i is not None), default=None)
                held = [k for k in group if before[k][0] == least and left[before[k]] > 0]
                assert held
                left[before[held[0]]] -= 1
        else:
            ids = packing.WordTokens(tokens.path("word_bpe_49k.json")).whole
            expected = Counter((r[0], len(ids(r[1] or "")) // 4 + 1) for r in before)
            got = Counter()
            for r in made.groupBy("doc_id").sum("length").collect():
                got[r[0]] += r[1]
            totals = Counter()
            for (i, n), times in expected.items():
                totals[i] += n * times
            assert got == totals
            for _, own in made.toPandas().sort_values("offset").groupby("sequence_id"):
                assert own.offset.tolist() == np.concatenate(([0], own.length.cumsum()[:-1])).tolist() and own.length.sum() <= 4096
        now = made
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def near_groups(all_texts, size=5):
    """Places of the texts of each component; texts without words are alone."""
    sets = []
    for t in all_texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    groups = []
    for k, s in enumerate(sets):
        met = [g for g in groups if any(s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in met] + [[k] + [j for g in met for j in g]]
    return groups


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(6))
    rows = [(1, a), (None, a + " end"), (None, b), (None, None), (2, c), (2, c), (3, d), (3, a + " more"), (None, e), (None, e), (5, f), (4, f + " end"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert kept == Counter([(1, a), (None, b), (None, None), (2, c), (3, d), (None, e), (4, f + " end"), (5, "")])
