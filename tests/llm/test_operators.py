"""The operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import io
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlab.llm import byte_bpe, canonical, language, licenses, media, mixing, near_dups, plane_store, quality, registry, token_counts

DATA = "/root/testdata/sf0.001"
ODD = [(None, None), (None, "x y"), (1, ""), (2, None), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "!!!"), (5, "é" * 50_000 + " z"), (6, "Σ İ ﬁ \x1c 漢字 <|endoftext|> <s>")]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string, n_tokens long"
    return spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, 1.0, 1, "n", 2) for k, (i, t) in enumerate(ODD)], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows_of(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key]))


def test_queries_keep_every_document(spark, docs):
    n = docs.count()
    for name, query in registry.QUERIES.items():
        if name not in ("op2_licenses", "op13_divergence"):
            assert query(spark, DATA).select("doc_id").distinct().count() == n, name


# --- 1


@pytest.mark.parametrize("kind", [plane_store.BYTES, plane_store.BITS])
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 65_536, 70_001):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        held = plane_store.Container(plane_store.write_container(ids, kind, chunk=1000))
        assert (held.ids() == ids).all() and (held.ids(900, 2100) == ids[900:2100]).all()


def test_store_gives_the_library_ids(spark, docs, odd):
    library = Tokenizer.from_file(plane_store.VOCABULARY)
    for table in (docs, odd, odd.limit(0)):
        store = plane_store.write_store(table, segment=5000, chunk=512)
        got = rows_of(plane_store.read_documents(store), "start")
        texts = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        texts.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        start = 0
        assert len(got) == len(texts)
        for r, (doc_id, text) in zip(got, texts):
            ids = library.encode(text, add_special_tokens=False).ids + [1]
            assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
            start += len(ids)


# --- 2


def test_alignment():
    words = "licensed under the apache license version 2 0".split()
    assert len(licenses.align(["x", *words, "y"], words)) == len(words)
    assert len(licenses.align(words[:3] + ["z"] + words[4:], words)) == len(words) - 1
    assert licenses.align([], words) == [] and licenses.align(words, []) == []


def test_scan(spark, odd):
    notice = licenses.TEMPLATES["GPL-3.0-notice"]
    rows = [(1, "foo " * 3000 + notice + " bar" * 3000), (2, notice.replace("General ", "")), (3, "clean text under the sun"), (4, None), (4, notice), (4, notice)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter({(1, "GPL-3.0-notice"): 1, (2, "GPL-3.0-notice"): 1, (4, "GPL-3.0-notice"): 2})
    first = next(r for r in got if r.doc_id == 1)
    assert first.coverage == 1 and rows[0][1][first.start : first.end] == notice[:-1]
    assert licenses.scan_licenses(odd).count() == 0


@pytest.mark.parametrize("name", [k for k, v in licenses.TEMPLATES.items() if len(v) < 500])
@pytest.mark.parametrize("times, between", [(2, 0), (2, 7), (2, 20), (50, 0), (50, 20)])
def test_scan_of_repeated_notices(name, times, between):
    notice, filler = licenses.TEMPLATES[name], "filler " * 20
    template = licenses._WORD.findall(notice.lower())
    for text in (notice, " ".join(w for k, w in enumerate(notice.split()) if k != 1)):
        joined = filler + (text + " " + "filler " * between) * times + filler
        found = licenses.scan(joined, {name: template})
        assert len(found) == times  # every copy, and nothing between them
        for hit in found:
            assert hit[1] >= (1 if text == notice else 1 - 1 / len(template) - 1e-9)
            assert licenses._WORD.findall(joined[hit[2] : hit[3]].lower())[0] == template[0]


def test_notices_of_other_licenses():
    split = {k: licenses._WORD.findall(v.lower()) for k, v in licenses.TEMPLATES.items()}
    cases = {
        "This text is licensed under CC BY 4.0 as it is": ["CC-BY-4.0-notice"],
        "licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0-notice"],
        "Released under the Apache License.": [],
        "Released under the BSD License.": ["BSD-notice"],
        "Released under the Zope License.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-notice"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0-notice"],
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1-notice"],
        "Licensed under the Apache License, Version 1.0.": [],
        "Licensed under the Academic License, version 2.0.": [],
        "Licensed under the Apache License, Version 2.0. And released under the MIT License.": ["Apache-2.0-notice", "MIT-notice"],
    }
    for text, names in cases.items():
        assert [x[0] for x in licenses.scan("some words " + text + " more words", split)] == names, text


def test_spread_templates_are_found():
    """A few foreign words after each word of a long template still give every copy; a span of many times its words is none."""
    grant = licenses.TEMPLATES["MIT-grant"].split()
    split = {"MIT-grant": licenses._WORD.findall(licenses.TEMPLATES["MIT-grant"].lower())}
    for between in (0, 1, 3, 40):
        for times in (1, 2, 5):
            text = " ".join(w + " foo bar baz"[: 4 * min(between, 3)] + " qux" * max(0, between - 3) for w in grant * times)
            found = licenses.scan("filler " * 50 + text, split)
            assert [x[1] for x in found] == ([1.0] * times if between < 40 else [])
            assert all(abs(x[4] * (between + 1) - 1) < 0.05 for x in found)


def naive_align(text, template, first=(0, 0)):
    """Patience alignment as it reads: equal ends, words that are unique on both sides, the longest rising run, the gaps."""
    x, y = first
    if not text or not template:
        return []
    if text[0] == template[0]:
        return [(x, y), *naive_align(text[1:], template[1:], (x + 1, y + 1))]
    if text[-1] == template[-1]:
        return [*naive_align(text[:-1], template[:-1], first), (x + len(text) - 1, y + len(template) - 1)]
    unique = [w for w in text if text.count(w) == 1 and template.count(w) == 1]
    run = licenses._rising([(text.index(w), template.index(w)) for w in unique])
    if not run:
        fits = len(text) <= (licenses.SPREAD + 1) * len(template) + licenses.SLACK
        return [(x + p, y + q) for p, q in licenses.longest_common(text, template)] if fits else []
    out, a, c = [], 0, 0
    for p, q in [*run, (len(text), len(template))]:
        out += naive_align(text[a:p], template[c:q], (x + a, y + c)) + ([(x + p, y + q)] if p < len(text) else [])
        a, c = p + 1, q + 1
    return out


def test_alignment_equals_a_naive_one():
    rng = np.random.default_rng(3)
    for k in range(400):
        size = 3 + k % 60
        a, b = (rng.integers(0, size, rng.integers(0, 60)).astype(str).tolist() for _ in range(2))
        assert licenses.align(a, b) == naive_align(a, b)
    for _ in range(200):  # the rising run is a longest one
        places = rng.permutation(rng.integers(1, 12)).tolist()
        best = [1] * len(places)
        for i, p in enumerate(places):
            best[i] = 1 + max([best[j] for j in range(i) if places[j] < p], default=0)
        run = licenses._rising(list(enumerate(places)))
        assert len(run) == max(best) and all(p[1] < q[1] for p, q in zip(run, run[1:]))


def test_scan_of_long_texts():
    """Edited copies of a long license are all found in linear time; a manual of the language holds none."""
    import pydoc_data.topics

    split = {k: licenses._WORD.findall(v.lower()) for k, v in licenses.TEMPLATES.items()}
    numbered, draw = licenses.number_words(split), random.Random(1)
    words = licenses.TEMPLATES["GPL-2.0"].split()
    edited = lambda: " ".join("zzz" if draw.random() < 0.03 else w for w in words if draw.random() > 0.03)
    began = time.perf_counter()
    found = licenses.scan(" some filler text ".join(edited() for _ in range(10)), split, numbered=numbered)
    assert [x[0] for x in found] == ["GPL-2.0"] * 10 and min(x[1] for x in found) > 0.88
    manual = "\n".join(pydoc_data.topics.topics.values())
    assert len(manual) > 400_000 and licenses.scan(manual, split, numbered=numbered) == []
    assert time.perf_counter() - began < 20


def test_scan_of_clashing_columns(spark):
    notice = licenses.TEMPLATES["GPL-3.0-notice"]
    df = spark.createDataFrame([(1, notice, "x", 0.5, 1), (None, notice, "y", 0.5, 2)], "doc_id long, text string, license string, coverage double, start int")
    assert sorted((r.doc_id is None, r.license, r.coverage) for r in licenses.scan_licenses(df).collect()) == [(False, "GPL-3.0-notice", 1.0), (True, "GPL-3.0-notice", 1.0)]


@pytest.mark.parametrize("cells", [1, 40, 10**9])
def test_halved_tables_have_the_most_common_words(cells, monkeypatch):
    monkeypatch.setattr(licenses, "CELLS", cells)
    rng = np.random.default_rng(11)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 20)).astype(str).tolist() for _ in range(2))
        pairs = licenses.common_words(a, b)
        assert len(pairs) == len(licenses.longest_common(a, b)) and all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_scan_of_nothing(spark, odd):
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_scan_of_whole_licenses():
    split = {k: licenses._WORD.findall(v.lower()) for k, v in licenses.TEMPLATES.items()}
    for name in ("MIT", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "Apache-2.0-header"):
        words = licenses.TEMPLATES[name].split()
        for text, least in ((words, 1), ([w for k, w in enumerate(words) if k % 10 != 5], 0.85)):
            found = {x[0]: x[1] for x in licenses.scan("filler " * 30 + " ".join(text) + " filler" * 30, split)}
            assert found[name] >= least


def test_longest_common_words():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).astype(str).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in np.ndindex(len(a), len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        pairs = licenses.longest_common(a, b)
        assert len(pairs) == table[-1, -1] and all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


# --- 3


def test_image_formats():
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_bmp(image)) == image).all()
    assert (media.decode_image(media.encode_netpbm(image)) == image).all()
    assert media.decode_netpbm(b"P2 # c\n2 2\n# d\n15\n0 15\n5 10\n").reshape(-1).tolist() == [0, 255, 85, 170]
    assert media.decode_netpbm(b"P1\n3 1\n101\n").reshape(-1).tolist() == [0, 255, 0]
    assert media.decode_netpbm(b"P4\n3 1\n\xa0").reshape(-1).tolist() == [0, 255, 0]
    with pytest.raises(ValueError):
        media.decode_image(b"P5\n9 9\n255\n12")


def test_area_resize_is_the_mean():
    image = np.random.default_rng(2).integers(0, 256, (12, 18), dtype=np.uint8)
    want = image.reshape(4, 3, 6, 3).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 4, 6)[:, :, 0], want)
    assert np.isclose(media.area_resize(image, 5, 7).mean(), image.mean())


def brute_grid(image, height, width):
    """Cell by cell: every sample by the part of it that the cell covers."""
    rows, columns = image.shape[:2]
    out = np.zeros((height, width, image.shape[2]))
    for y, x in np.ndindex(height, width):
        down = np.clip(np.minimum(np.arange(rows) + 1, (y + 1) * rows / height) - np.maximum(np.arange(rows), y * rows / height), 0, 1)
        right = np.clip(np.minimum(np.arange(columns) + 1, (x + 1) * columns / width) - np.maximum(np.arange(columns), x * columns / width), 0, 1)
        out[y, x] = np.einsum("r,c,rcb->b", down, right, image.astype(float)) / (down.sum() * right.sum())
    return out


@pytest.mark.parametrize("block", [1, 50, 10**6])
def test_grids_in_blocks_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(media, "BLOCK_SAMPLES", block)
    rng = np.random.default_rng(4)
    for shape in ((1, 1, 1), (3, 5, 3), (24, 24, 1), (97, 24, 1), (40, 7, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for got, (h, w) in zip(media.area_grids(image, [(16, 16), (8, 9)]), [(16, 16), (8, 9)]):
            assert np.allclose(got, brute_grid(image, h, w))
    with pytest.raises(ValueError):
        media.area_grids(np.zeros((0, 4, 1), np.uint8), [(8, 9)])


def test_stored_tiles(spark, docs):
    """The tile that was stored is that of the stored image; the query's feature is made of both."""
    stored = media.store_payloads(docs)
    rows = {r.doc_id: r for r in stored.collect()}
    got = {r.doc_id: r.feature for r in media.payload_features(stored).collect()}
    for doc_id, r in list(rows.items())[:40]:
        image = media.decode_image(bytes(r.media))
        small = np.load(io.BytesIO(bytes(r.tile)))
        want = np.clip(np.rint(brute_grid(image, 16, 16)), 0, 255).astype(np.uint8)
        grey = brute_grid(image, 8, 9).mean(axis=2)
        assert small.shape == (16, 16, 1) and (abs(small.astype(int) - want) <= 1).all()
        assert r.dhash == np.packbits(grey[:, 1:] > grey[:, :-1] + 1e-9).tobytes().hex()
        assert got[doc_id] == f"24x{image.shape[0]}:{r.dhash}:{zlib.crc32(small.tobytes()):08x}"
    assert media.payload_features(media.store_payloads(docs.limit(0))).count() == 0
    assert media.media_features(stored.select("doc_id", "media", "tile", "dhash")).where("tile is null").count() == 0


def test_payloads(spark, docs, odd):
    for table in (docs, odd):
        got = Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media.payload_features(media.store_payloads(table)).collect())
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            data = (r.text or "").encode()
            padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
            want[r.doc_id, len(data), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
        assert got == want
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert all(r.dhash is None for r in media.media_features(bad).collect())


# --- 4


def test_mix_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[1:] for r in duck.sql(mixing.OP4_SQL).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in mixing.op4_mixing(spark, DATA).collect()}
    assert got == want


def test_mix_meets_targets(spark, docs, odd):
    for table in (docs, odd):
        rows = mixing.mix_sizes(table).collect()
        assert len(rows) == table.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
        total = sum(r["size"] for r in rows)
        targets = {(r.source_size, r.target) for r in rows}
        assert all(t <= 2 * s for s, t in targets)
        assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 3 * 20 + len(ODD)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.select("text").collect())
    assert words == sum(r.taken for r in mixing.mix_sizes(docs).collect())
    assert mixing.mix_sizes(odd.limit(0)).count() == 0


# --- 5


def fold(text):
    for form in ("NFKD", "NFKD"):
        text = unicodedata.normalize(form, unicodedata.normalize(form, text).casefold())
    return re.sub("[ \t\n\x0b\x0c\r\x85   -     　]+", " ", unicodedata.normalize("NFKD", text)).strip(" ")


def test_canonical_form(spark):
    r = random.Random(3)
    parts = ["a", "B", "é", "é", "́", "̣", "ͅ", "ß", "ﬁ", "한", "ᄀ", "Ⅳ", "\x01", " ", " ", "\n", "İ", "Σ", "ς", "😀", "ậ", "…", "ᾳ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(800)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical(F.col("t")).alias("c")).collect()
    assert [g.c for g in got] == [fold(t) for t in texts]


def test_edited_fingerprints(spark, docs, odd):
    texts = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    got = rows_of(canonical.edited_fingerprints(docs))
    groups = {}
    for k, (r, (doc_id, text)) in enumerate(zip(got, texts)):
        n, after = len(text), texts[(k + 1) % len(texts)][1]
        edited = text[: n - n // 4] + after[: n // 4]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(fold(text) == fold(edited)) and r.near_next == float(fold(text) == fold(after))
        groups.setdefault(fold(text), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in groups.values()) and len({y for x in groups.values() for y in x}) == len(groups)
    assert canonical.edited_fingerprints(odd).count() == len(ODD)
    assert canonical.edited_fingerprints(odd.limit(0)).count() == 0


def test_hot_doc_ids_are_dealt_out(spark):
    """A third of all rows without doc_id and a third with one: the same rows in the same order, whatever the buckets."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k} " * (k % 5 + 1)) for k in range(300)]
    got = canonical.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ordered = spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id", F.xxhash64("text")).collect()
    want = Counter()
    for k, (doc_id, text) in enumerate(ordered):
        n, after = len(text), ordered[(k + 1) % len(ordered)].text
        want[doc_id, hashlib.sha256((text[: n - n // 4] + after[: n // 4]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_exact_groups_of_nothing(spark, odd):
    assert canonical.exact_groups(odd.limit(0)).count() == 0


# --- 6, 7


def test_token_counts(spark, docs, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    for table in (docs, odd):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in table.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table).collect()) == want


def test_merging_overlaps():
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    held = token_counts.Merger(open(token_counts.MODEL, "rb").read())
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "aa", " ", "  ", "the", "\n", "漢", "▁", "0"]) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    assert held.count_texts(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_long_runs_are_counted_in_time():
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    held = token_counts.Merger(open(token_counts.MODEL, "rb").read())
    r = random.Random(8)
    runs = [c * n + end for c in " #=-a0.\n_x/*éア漢" for n in (1, 2, 3, 15, 16, 17, 31, 33, 100, 1000, 10_007) for end in ("", "the", "#", " x")]
    mixed = ["".join(r.choice(" #=-a0.xABth_/+") * r.choice((1, 2, 5, 40)) for _ in range(300)) for _ in range(200)]
    base = ["".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(20_000)) for _ in range(2)]
    for texts in (runs, mixed, base):
        assert held.count_texts(texts).tolist() == [len(x) for x in library.encode(texts)]
    began = time.perf_counter()
    spaces, hashes = held.count_texts([" " * 1_000_000, "#" * 1_000_000]).tolist()
    assert time.perf_counter() - began < 10
    assert [spaces, hashes] == [len(library.encode(c * 1_000_000)) for c in " #"]


def test_byte_bpe(spark, docs, odd):
    encoding = byte_bpe._encoding(open(byte_bpe.RANKS, "rb").read(), public_tokenizers.PATTERN)
    for table in (docs, odd):
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            ids = encoding.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encoding_digests(table).collect())
        assert got == want
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(odd, keep=["doc_id", "text"])).collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back)


def test_safe_parts():
    encoding = byte_bpe._encoding(open(byte_bpe.RANKS, "rb").read(), public_tokenizers.PATTERN)
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice(["a", "don't", " ", "  ", "\n", "1", "!", "\x1c", " "]) for _ in range(60))
        parts = list(byte_bpe.safe_parts(text, 5))
        assert "".join(parts) == text and [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
    assert isinstance(encoding, tiktoken.Encoding)


# --- 8, 9


def test_language_accuracy(spark, docs, odd):
    got = language.op8_language(spark, DATA).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and len(r.text) > 40]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    learned = language.learn_profiles(docs)
    preds = {(r.doc_id, r.lang_pred) for r in language.identify(odd, learned, ["doc_id", "text"]).where("text is null or text = '' or text = '!!!'").collect()}
    assert {p for _, p in preds} == {"und"}
    assert all(r.lang_pred == "und" for r in language.identify(odd, language.learn_profiles(odd.limit(0)), ["doc_id"]).collect())


def test_quality_accuracy(spark, odd):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    rows = [r for r in quality.op9_quality(spark, data).join(labels, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    none = quality.fit_ranking(np.zeros((0, len(quality.NAMES))), np.zeros(0))
    assert none is None and all(r.score == 0.5 for r in quality.quality_scores(odd, None, ["doc_id"]).collect())


def test_language_equals_brute_force(spark, docs):
    """Every document's language and cosine, gram by gram."""
    size, vectors = language.DIMENSIONS, {}

    def vector(letter):
        if letter not in vectors:
            rng = np.random.Generator(np.random.PCG64([language.SEED, ord(letter)]))
            vectors[letter] = rng.integers(0, 2, size, np.int8).astype(float) * 2 - 1
        return vectors[letter]

    def bundle(text):
        plain = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        plain = re.sub(" +", " ", plain)
        grams = Counter(plain[k : k + 3] for k in range(len(plain) - 2) if plain[k + 1] != " ")
        total = np.zeros(size)
        for (a, b, c), n in grams.items():
            total += n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return total / (np.linalg.norm(total) or 1)

    rows = docs.select("doc_id", "text", "lang").collect()
    found = {r.doc_id: bundle(r.text) for r in rows}
    learn = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    names = sorted({r.lang for r in learn})
    sums = np.array([sum(found[r.doc_id] for r in learn if r.lang == name) for name in names])
    sums /= np.linalg.norm(sums, axis=1, keepdims=True)
    sums -= sums.mean(axis=0) / 2
    sums /= np.linalg.norm(sums, axis=1, keepdims=True)
    for r in language.op8_language(spark, DATA).collect():
        near = sums @ found[r.doc_id]
        if not found[r.doc_id].any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        assert abs(r.score - max(0, near.max())) < 1e-4 and near[names.index(r.lang_pred)] > near.max() - 1e-4


def plain_features(text):
    if not text:
        return [0.0] * len(quality.NAMES)
    data = [chr(b) for b in text.encode()]
    kinds = [str.isupper, str.isdigit, " \t\r\n".__contains__, ".,".__contains__, "!?".__contains__, "|".__contains__, "#$%&*@^~_=+<>{}[]\\/".__contains__]
    ascii_ = [c for c in data if c < "\x80"]
    shares = [sum(map(kind, ascii_)) / len(data) for kind in kinds]
    other = sum(not c.islower() and not any(kind(c) for kind in kinds) for c in ascii_) / len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    repeats = sum(words[k] == words[k - 1] for k in range(1, len(words)))
    return shares + [other, repeats / n, len(set(words)) / n**0.85, np.log(1 + len(data) / n), 1 - len(set(lines)) / max(1, len(lines)), float(any(len(w) > 40 for w in words)), np.log(1 + n)]


def test_quality_equals_brute_force(spark):
    """Every document's score, with features character by character and weights by plain descent over the same pairs."""
    data = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = sorted(i for i in labels if i in texts and labels[i] in (0, 1) and zlib.crc32(str(i).encode()) % 5 != 0)
    x, y = np.array([plain_features(texts[i]) for i in ids]), np.array([labels[i] for i in ids])
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0))
    z, rng, n = (x - mean) / scale, np.random.default_rng(quality.SEED), max((y == 1).sum(), (y == 0).sum())
    sides = [np.concatenate([rng.permutation(np.resize(np.flatnonzero(y == label), n)) for _ in range(quality.PAIR_ROUNDS)]) for label in (1, 0)]
    diff, w = z[sides[0]] - z[sides[1]], np.zeros(x.shape[1])
    rate = 1 / (np.linalg.eigvalsh(diff.T @ diff / len(diff)).max() / 4 + quality.RIDGE)
    ahead, before = w, w
    for k in range(20_000):
        wrong = 1 / (1 + np.exp(diff @ ahead))
        before, w = w, ahead + rate * (diff.T @ wrong / len(diff) - quality.RIDGE * ahead)
        ahead = w + k / (k + 3) * (w - before)
    cut = np.quantile(z @ w, (y == 0).mean())
    for r in quality.op9_quality(spark, data).collect():
        raw = ((np.array(plain_features(texts[r.doc_id])) - mean) / scale) @ w - cut
        assert abs(r.score - 1 / (1 + 7 / 3 * np.exp(-raw))) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


# --- 10


def bag(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(texts):
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    bags = [bag(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            shared, union = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if texts[a] == texts[b] or (union and 5 * shared >= 4 * union):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(texts))]


def test_weighted_similarity_is_unbiased():
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    off = []
    for _ in range(120):
        base = words(40)
        pair = [" ".join([base] * r.randint(1, 6) + [words(20)]) for _ in range(2)]
        signs = [np.frombuffer(s, "<u2") for s in near_dups._signed(pair)["signature"]]
        x, y = bag(pair[0]), bag(pair[1])
        off.append((signs[0] == signs[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_near_classes(spark, docs, odd, monkeypatch):
    texts = [r.text or "" for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    want = brute_classes(texts)
    got = rows_of(near_dups.near_duplicates(docs))
    assert [r.class_id for r in got] == [got[k].doc_id for k in want]
    assert near_dups.keep_first(docs).count() == len(set(want))
    assert near_dups.near_duplicates(odd).count() == len(ODD)
    assert near_dups.keep_first(odd).columns == odd.columns and near_dups.keep_first(odd).count() == len({t or "" for _, t in ODD})
    for name, value in (("BLOCK", 12), ("SPLIT", 20), ("PART", 10)):  # a large group takes all ways
        monkeypatch.setattr(near_dups, name, value)
    r = random.Random(7)
    base = [[f"v{r.randrange(900)}" for _ in range(80)] for _ in range(2)]
    texts = []
    for k in range(70):
        words = list(base[k % 2])
        for _ in range(r.randint(0, 3)):
            words[r.randrange(80)] = f"v{r.randrange(900)}"
        texts.append(" ".join(words))
    got = rows_of(near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [x.class_id for x in got] == brute_classes(texts)


def test_shared_passages_are_no_classes(spark, monkeypatch):
    """Many texts that share a passage crowd their bands and hang together as candidates; the classes stay those of brute force."""
    for name, value in (("BLOCK", 8), ("SPLIT", 12), ("PART", 6), ("DEALS", 3)):
        monkeypatch.setattr(near_dups, name, value)
    finer, calls = near_dups._finer, []
    monkeypatch.setattr(near_dups, "_finer", lambda rows, *more: calls.append(more) or finer(rows, *more))
    r = random.Random(11)
    words = lambda n: [f"p{r.randrange(10**5)}" for _ in range(n)]
    passage, texts = words(150), []
    for k in range(60):
        own = words(60)
        texts += [" ".join(passage + own)]
        if k % 4 == 0:  # a near copy
            own[-1] = "changed"
            texts += [" ".join(passage + own)]
    got = rows_of(near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = brute_classes(texts)
    assert len(set(want)) == 60 and [x.class_id for x in got] == want
    assert {(), ("root",)} <= set(calls)  # both the candidates and the comparison met crowded bands


def test_long_components_are_compared_in_blocks(spark, monkeypatch):
    """Components of few but long texts take the way of large ones."""
    monkeypatch.setattr(near_dups, "BLOCK_CHARS", 400)
    r = random.Random(12)
    base = [f"q{r.randrange(10**5)}" for _ in range(100)]
    texts = [" ".join(base[:-1] + [f"z{k}"]) for k in range(5)] + [" ".join(base[:70] + [f"y{k}_{j}" for j in range(30)]) for k in range(4)]
    got = rows_of(near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [x.class_id for x in got] == brute_classes(texts)


def test_recall_of_near_pairs(spark):
    """Documents whose id is divisible by 50 against all documents: pairs of an overlap of 0.8 or more share a class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.class_id for r in near_dups.near_duplicates(rows).collect()}
    bags = {r.doc_id: bag(r.text or "") for r in rows.collect()}
    sizes = {k: sum(b.values()) for k, b in bags.items()}
    want = []
    for a in (k for k in bags if k % 50 == 0):
        for b in bags:
            if a != b and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]) > 0:
                shared = sum((bags[a] & bags[b]).values())
                if 5 * shared >= 4 * (sizes[a] + sizes[b] - shared):
                    want.append((a, b))
    assert want and sum(found[a] == found[b] for a, b in want) >= 0.9 * len(want)


def test_clashing_columns_and_nothing(spark, docs):
    """Columns named as an operator's own, in any case, and empty tables."""
    names = ["__own", "__text", "row", "size", "hash", "key", "cut", "taken", "node", "media", "Ids", "N_tokens", "lang_pred"]
    wide = docs.limit(60).withColumns({n: F.lit("x") for n in names})
    assert near_dups.keep_first(wide).columns == wide.columns
    mixed = mixing.mix_documents(wide)
    assert mixed.columns == wide.columns and {r[0] for r in mixed.select("key").distinct().collect()} == {"x"}
    profiles = language.learn_profiles(docs)
    assert language.keep_known(wide, profiles).columns == wide.columns
    assert language.identify(wide, profiles).where("lang_pred = 'x'").count() == 0
    assert byte_bpe.encode_documents(wide).count() == token_counts.count_tokens(wide, keep=None).count() == 60
    none = wide.limit(0)
    for got in (near_dups.keep_first(none), near_dups.near_duplicates(none), mixing.mix_documents(none), language.keep_known(none, profiles), byte_bpe.encoding_digests(none), token_counts.count_tokens(none), language.op8_language, quality.quality_scores(none, None)):
        assert callable(got) or got.count() == 0


def test_quality_learns_from_every_label(spark):
    """More labels than a block: every learnable document is in its own block once, every block has both labels, the sums and the
    cut are those of all rows."""
    rows = spark.range(26_000).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('word ', int(id % 13) + 1), repeat('!', int(id % 7)), id)").alias("text"), F.expr("int(id % 5 > 0)").alias("quality"))
    n = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % quality.FOLDS != 0).count()
    blocks, sizes = quality.labelled_features(rows.drop("quality"), rows.drop("text"))
    assert sizes.sum() == n > 20_000 and blocks.count() == -(-n // quality.BLOCK)
    blocks, sizes = quality.labelled_features(rows.drop("quality").where("doc_id < 900"), rows.drop("text").where("doc_id % 5 > 0 or doc_id % 50 = 0"), block=60, sent=5)
    sides = [[np.frombuffer(x).reshape(-1, len(quality.NAMES) + 1) for x in (r.bad, r.good)] for r in blocks.collect()]
    assert len(sides) > 5 and all(len(bad) and len(good) for bad, good in sides)
    own = [np.vstack([s[k][s[k][:, -1] == 1, :-1] for s in sides]) for k in (0, 1)]
    assert [len(x) for x in own] == sizes.tolist()
    found, every = quality.fit_ranking(blocks, sizes), np.vstack(own)
    assert np.allclose(found.mean, every.mean(axis=0)) and np.allclose(np.quantile(found.raw(every), sizes[0] / sizes.sum()), found.threshold)
    plain = quality.fit_ranking(every, np.repeat([0, 1], sizes))
    assert np.corrcoef(found.score(every), plain.score(every))[0, 1] > 0.99


def test_language_learns_from_every_text(spark):
    """More texts of a language than were learned once: prototypes and threshold are those of all of them."""
    rows = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"), F.expr("concat('words of ', substring(sha2(string(id), 256), 1, 20))").alias("text"))
    learned = [r.text for r in rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % language.FOLDS != language.HELD_OUT).collect()]
    total = language.Letters().bundles(learned).sum(axis=0)
    profiles, least = language.learn_with_threshold(rows)
    assert len(learned) > 6_000 and np.allclose(profiles.prototypes[0], total / np.linalg.norm(total), atol=1e-5)
    cosines = sorted(profiles.nearest(learned)[1])
    assert abs(cosines[int(np.ceil(len(learned) * language.LOW_QUANTILE)) - 1] - 1e-5 - least) < 1e-6
