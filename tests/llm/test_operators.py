import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("factweave.llm")
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from factweave.llm import bpe, bytebpe, decontaminate, fingerprints, langid, pseudolm, simhash, suffixdedup, tokenfile, toxicity, warc  # noqa: E402
from factweave.llm.common import word_hashes  # noqa: E402
from factweave.llm.components import components  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 3000), (5, "one two three four five " * 400), (6, "é日本👍 ok"), (7, "same text here for all"), (8, "same text here for all"), (8, "same text here for all"), (None, "no id at all"), (9, "<|endoftext|> 12,345 it's  two")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "sp", 1.0) for i, t in ODD], "doc_id bigint, text string, score_ string, n_tokens double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_bpe_matches_the_library(odd, empty):
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = []
    for i, t in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, bpe.round_trip(odd, PATH).collect()))) == sorted(map(repr, want))
    back = bpe.decode_column(bpe.encode_column(odd, PATH), PATH)
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect()) and "n_tokens" in back.columns
    assert bpe.round_trip(empty, PATH).count() == 0


def test_transducer_is_stable_whatever_the_window(monkeypatch):
    coder, lib, rng = bytebpe.ByteBPE(PATH), tokenizers.Tokenizer.from_file(PATH), random.Random(3)
    pieces = ["".join(rng.choice(a) for _ in range(rng.randint(1, 4000))) for a in ("ab", "=-_", "thing", "aeiou", "日本語字") for _ in range(4)] + ["a" * 9000]
    want = [lib.encode(p, add_special_tokens=False).ids for p in pieces]
    least = coder.lookahead + max(coder.token_sizes)
    for window in (coder.window, least, least + 7):
        coder.window = window
        assert coder.transduce([p.encode() for p in pieces]) == want
        for chunk in (1, 50, 100_000):
            assert all(list(coder.stream([raw[k : k + chunk] for k in range(0, len(raw), chunk)])) == w for raw, w in zip([p.encode() for p in pieces[::3]], want[::3]))
    short = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 64))).encode() for _ in range(500)]
    assert coder.transduce(short) == [coder.merge_all(p) for p in short]
    monkeypatch.setattr(bytebpe, "WINDOW_CHARS", 5)
    for t in ["a  b c\n d", " lead and trail ", "   ", "x" * 20, ""]:
        assert " ".join(" ".join(w) for w in bytebpe.words_of(t)) == t


def test_pieces_of_parts():
    rng = random.Random(77)
    signs = "abzé日ß.,;:!?*$&#%()-_\"'0١²\u00a0\u200b🙂s t"
    parts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    parts += ["it's", "dogs'", "'tis", "we'll.", "x''s", "don't!!", "naïve,“", "a_b", "--", ""]
    assert [bytebpe.pieces_of(p) for p in parts] == [bytebpe.PIECES.findall(" " + p) for p in parts]


def test_every_piece_goes_through_the_transducer(monkeypatch):
    monkeypatch.setattr(bpe, "_CODERS", {})
    passed: list[bytes] = []
    plain = bytebpe.ByteBPE.transduce

    def noted(self, pieces):
        passed.extend(pieces)
        return plain(self, pieces)

    monkeypatch.setattr(bytebpe.ByteBPE, "transduce", noted)
    texts = [t for _, t in ODD] + ["q" * 70_000 + " and 日本語" * 300, "once more", "once more"]
    lib = tokenizers.Tokenizer.from_file(PATH)
    for windows, t in zip(bpe.by_slices(PATH, texts, limit=1000), texts):
        assert bpe.digest_windows(PATH, windows)[0] == len(lib.encode(t or "", add_special_tokens=False).ids)
    coder = bpe.coder(PATH)[0]
    pieces = {p.encode() for t in texts for span in coder.spans(t or "") if isinstance(span, str) for p in bytebpe.PIECES.findall(span)}
    assert set(passed) == pieces
    # a cache holds bounded bytes, and no long part
    cache = bpe.coder(PATH)[2]
    assert all(len(p if isinstance(p, str) else p[0]) <= bytebpe.LONGEST for p in cache)
    cache.limit = 1
    list(bpe.by_slices(PATH, ["one two three", "four"], limit=1))
    assert len(cache) <= 2


def test_token_files(odd, empty):
    lib = tokenizers.Tokenizer.from_file(PATH)
    rows = tokenfile.read_tokens(tokenfile.write_tokens(odd, PATH, rows_per_bucket=3)).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert got == sorted((i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in ODD for ids in [lib.encode(t or "", add_special_tokens=False).ids + [0]])
    assert tokenfile.read_tokens(tokenfile.write_tokens(empty, PATH)).count() == 0
    rng = np.random.default_rng(0)
    for top in (2, 300, 70_000, 1 << 25):
        parts = [rng.integers(0, top, n).astype(np.uint32) for n in (0, 1, 7, 900)]
        names, lengths, ids, before = tokenfile.read_shard(tokenfile.pack_shard([None, -1, 5, 9], parts, 3))
        assert names == [None, -1, 5, 9] and lengths.tolist() == [0, 1, 7, 900] and before == 3 and (ids == np.concatenate(parts)).all()


def _plain_fingerprint(text):
    ws = bytes((text or "").encode()).lower().split()
    sh = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_parts_encode_as_whole_texts(monkeypatch):
    lib = tokenfile.Library(PATH, limit=9)
    monkeypatch.setitem(tokenfile._LIBRARY, PATH, lib)
    texts = ["", " ", "a", "  a  b ", "it's dogs' 'tis. word'; x***\n y,\n\n  z\t q", "naïve, “né”. ²³ 12. año!? ١٢ \u00a0 x\u00a0y", "a\x1c b\x85 c \u200b d", "<|endoftext|> tail", "end ", "日本語。 🙂🙂 ok" * 9]
    whole = [lib.whole(t) for t in texts]
    assert list(tokenfile.encoded(PATH, texts)) == whole
    lib.plain = False
    assert list(tokenfile.encoded(PATH, [*texts, None])) == [*whole, b""]


def test_simhash(spark, odd, empty):
    rng = random.Random(5)
    docs = list(ODD)
    base = words(rng, 120)
    for k in range(60):
        ws = base.split() if k < 40 else words(rng, rng.randint(1, 60)).split()
        if k % 3:
            ws[rng.randrange(len(ws))] = "changed"
        docs.append((100 + k, " ".join(ws)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert {k[0]: k[1] for k in got} == {i: _plain_fingerprint(t) for i, t in docs}
    fps = sorted({k[1] for k in got})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            up[root(a)] = root(b)
    least = {}
    for i, f in got:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    assert all(c == least.get(root(f)) for (i, f), c in got.items())
    assert simhash.near_duplicates(empty).count() == 0


def test_bit_sliced_distances(monkeypatch, spark):
    rng = np.random.default_rng(1)
    f = np.unique(np.concatenate([b := rng.integers(0, 2**63, 90, dtype=np.uint64)] + [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, False))) for k in range(1, 8)]))
    for r in (0, 3, 4, 7):
        a, b_ = simhash.within(f, f, r, True)
        assert set(zip(a.tolist(), b_.tolist())) == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if int(f[i] ^ f[j]).bit_count() <= r}
    # buckets over the block size are cut into pieces, and no link is lost
    monkeypatch.setattr(simhash, "BLOCK", 40)
    df = spark.createDataFrame([(int(x) - (1 << 64) if x >> 63 else int(x),) for x in f.tolist()], "fp bigint")
    edges = {frozenset((r["a"], r["b"])) for r in simhash.links(df).collect()}
    assert all((x % 2**64 ^ y % 2**64).bit_count() <= 4 for x, y in map(tuple, edges))
    names = {int(x) - (1 << 64) if x >> 63 else int(x) for x in f.tolist()}
    comp = {r["id"]: r["component"] for r in components(spark.createDataFrame([tuple(e) for e in edges], "a bigint, b bigint")).collect()}
    signed = lambda x: x % 2**64
    for x, y in itertools.combinations(sorted(names), 2):
        if (signed(x) ^ signed(y)).bit_count() <= 4:
            assert comp.get(x, x) == comp.get(y, y)


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_simhash_tables_miss_nothing_and_dont_grow(radius):
    edges, choices = simhash.layout(radius)
    assert edges[0] == 0 and edges[-1] == 64 and len(choices) == (radius + 2) * (radius + 1) // 2
    for blocks in itertools.combinations(range(radius + 2), radius):  # differing bits touch so many blocks at most
        assert any(not set(c) & set(blocks) for c in choices)


def test_simhash_units_of_near_copies_stay_thin():
    base = np.uint64(0x123456789ABCDEF0)
    near = np.unique(np.array([base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)], np.uint64))
    a, b = simhash.block_links(near, np.full(len(near), 2, np.int8), 4)  # all two million pairs link
    assert len(a) == len(near) - 1 == len(set(a.tolist()) | set(b.tolist())) - 1
    side = (np.arange(len(near)) % 2).astype(np.int8)
    a, b = simhash.block_links(near, side, 4)
    assert len(a) == len(near) - 1 and set(a.tolist()) <= set(near[side == 0].tolist()) and set(b.tolist()) <= set(near[side == 1].tolist())


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 300), (5, 5), (7, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _cut(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()
    return out


@pytest.mark.parametrize("hot,often", [(20_000, 16), (2, 16), (20_000, 1), (3, 2)])
def test_suffix_dedup(spark, monkeypatch, hot, often):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "SEEN", 64 if often == 16 else 1)  # else many anchors are common
    monkeypatch.setattr(suffixdedup, "OFTEN", often)
    rng = random.Random(hot + often)
    base = [words(rng, 60) for _ in range(3)]
    rows = [(300, None), (301, ""), (302, "a" * 400), (303, "ab" * 160), (304, "a" * 120), (305, "é" * 90)]
    for i in range(70):
        t = words(rng, rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            s = rng.randint(0, 100)
            t += rng.choice(base)[s : s + rng.randint(90, 190)] + rng.choice(["", "é", " "])
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.summarize(df).collect()} == _cut(rows)
    # rows that repeat in full are one document
    twice = df.where("doc_id = 302").unionByName(df.where("doc_id = 302"))
    assert {tuple(r)[1:] for r in suffixdedup.summarize(twice).collect()} == {_cut([(302, "a" * 400)])[302]}


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    rng = random.Random(31)
    page = words(rng, 40)
    long = " ".join(words(rng, 30) + " " + (page if k % 9 == 0 else "") for k in range(700))
    rows = [(1, long), (2, page), (3, long[60_000:70_000] + "é" * 120), (4, words(rng, 20) + long[-500:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _cut(rows)
    for size in (4096, 1 << 18):  # pieces that overlap
        monkeypatch.setattr(suffixdedup, "SLICE", size)
        assert {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.summarize(df).collect()} == want
    big = words(rng, 260_000)  # beyond a megabyte
    assert len(big) > 1_000_000
    got = {r["doc_id"]: r for r in suffixdedup.summarize(spark.createDataFrame([(1, big), (2, big[500_000:501_000])], "doc_id bigint, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 1000


def test_suffix_dedup_keeps_rows(odd, empty):
    out = suffixdedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert suffixdedup.summarize(empty).count() == 0


def test_bucket_pointers():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(100, 180))) for _ in range(40)]
    texts += texts[:5]
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    got = suffixdedup.repeated(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes - 99, np.arange(len(raw)), np.zeros(len(raw), np.int64))
    seen, want = set(), []
    for r in raw:
        for p in range(len(r) - 99):
            want.append(r[p : p + 100] in seen)
            seen.add(r[p : p + 100])
    assert got.tolist() == want


def test_decontamination(spark, odd, empty):
    rng = random.Random(7)
    items = [(k, words(rng, rng.randint(15, 50))) for k in range(12)] + [(90, None), (91, ""), (92, "two words")]
    docs = [(i, t) for i, t in ODD if i is not None]
    for k in range(40):
        ws = words(rng, 40).split()
        if k % 2:
            item = rng.choice(items[:12])[1].split()
            s = rng.randint(0, len(item) - 15)
            part = item[s : s + 15]
            for j in rng.sample(range(15), rng.randint(0, 5)):
                part[j] = "other"
            ws[10:10] = part
        docs.append((100 + k, " ".join(ws)))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for i, t in docs:
        dw = (t or "").lower().split()
        for k, it in items[:12]:
            iw = it.split()
            for shift in range(-len(iw), len(dw)):
                eq = [0 <= j + shift < len(dw) and dw[j + shift] == w for j, w in enumerate(iw)]
                if max(sum(eq[s : s + 15]) for s in range(len(eq) - 14)) >= 12:
                    want.setdefault(i, set()).add(k)
    for inline in (200_000, 0):
        got = decontaminate.overlaps(d, b, inline=inline).collect()
        assert {i: {r["item"] for r in got if r["doc"] == i} for i in {r["doc"] for r in got}} == want
    kept = decontaminate.decontaminate(odd, b)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert decontaminate.overlaps(odd, b.limit(0)).count() == 0 and decontaminate.overlaps(empty, b).count() == 0


@pytest.mark.parametrize("inline", [200_000, 0])
def test_decontamination_of_short_items(spark, inline):
    rng = random.Random(15)
    items = [(n, words(rng, n)) for n in range(1, 15)] + [(50, words(rng, 20)), (51, None), (52, "--")]
    docs = []
    for k in range(160):
        ws = words(rng, rng.randint(0, 12)).split()
        part = items[k % 14][1].split()
        for j in rng.sample(range(len(part)), min(len(part), rng.randint(0, 3))):
            part[j] = "changed"
        docs.append((k if k != 7 else None, " ".join([*ws, *part, *words(rng, 3).split()])))
    docs += [(200, items[14][1]), (201, None), (None, items[13][1]), (None, "nothing of it")]
    want = set()
    for i, t in docs:
        dw = (t or "").lower().split()
        for k, it in items[:15]:
            iw = it.split()
            width = min(15, len(iw))
            for shift in range(-len(iw), len(dw)):
                eq = [0 <= j + shift < len(dw) and dw[j + shift] == w for j, w in enumerate(iw)]
                most = max(sum(eq[s : s + width]) for s in range(len(eq) - width + 1))
                if most >= -(-width * 4 // 5):
                    want.add((i, k, shift, most))
    got = [tuple(r) for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), inline=inline).collect()]
    assert len(want) > 60 and set(got) == want and len(got) == len(want)


def test_runs_are_lossless():
    for n in range(1, 15):
        runs = decontaminate.runs_of(n)
        assert sum(size for _, size in runs) == n and all(size for _, size in runs)
        for bad in itertools.combinations(range(n), n - decontaminate.needed(n)):
            assert any(not set(range(at, at + size)) & set(bad) for at, size in runs)


def test_masks_are_lossless():
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.NEED):
        assert any(not any(s + p in bad for p in m) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def test_warc(spark):
    big = "<p>" + "x" * 200
    pages = [(1, "http://a b/", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "é" * 60), (0, "u", "é" * 60)]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id bigint, url string, html string, digest int")
    table = warc.write_archives(df)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_archives(table).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        refers = {2: 1, None: 1, 7: 0}.get(i)
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers)
    bundles = {r["bundle"]: bytes(r["payload"]) for r in table.collect()}
    for r in warc.record_index(table).collect():
        head, block = warc.fetch_record(bundles[r["bundle"]], r["frame"], r["offset"])
        assert head.get("X-Page-Id") == (None if r["id"] is None else str(r["id"]))
    # the entries lead to the records, whatever their order and whatever lies between them
    turned = table.selectExpr("bundle", "payload", "reverse(filter(index, i -> i.id % 2 = 0)) index")
    assert sorted(r["page_id"] for r in warc.read_archives(turned).collect()) == [0, 2, 4, 6]
    wrong = table.selectExpr("payload", "transform(index, i -> named_struct('id', i.id + 1, 'frame', i.frame, 'offset', i.offset, 'length', i.length)) index")
    with pytest.raises(Exception, match="doesn't fit"):
        warc.read_archives(wrong).collect()
    w = warc.BundleWriter(frame_bytes=500)
    for k in range(20):
        w.add(k, warc.record("response", k, "u", b"z" * 100, "d", 100, None))
    raw = w.finish()
    assert len(warc.seek_table(raw)) > 3 and all(warc.fetch_record(raw, f, o)[0]["X-Page-Id"] == str(k) for k, f, o, _ in w.index)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_of_hot_and_long_payloads(spark):
    import random as plain

    noise = "".join(plain.Random(5).choices("abcdefghijklmnop <>/", k=3_000_000))  # beyond a frame
    rows = [(k, "u%d" % k, "<html>" + "same " * 40) for k in range(300)] + [(1000, None, noise), (1001, "v", noise), (1002, "w", noise[:-1])]
    table = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = {r["page_id"]: r for r in warc.read_archives(table).collect()}
    assert len(got) == len(rows) and got[0]["record_type"] == "response" and all(got[k]["refers_to"] == 0 for k in range(1, 300))
    assert got[1001]["refers_to"] == 1000 and got[1002]["record_type"] == "response"
    assert all(got[i]["payload_digest"] == hashlib.sha256(t.encode()).hexdigest() for i, _, t in rows)


def test_long_texts_are_taken_in_blocks(spark, monkeypatch):
    from factweave.llm import common

    rng = random.Random(70)
    texts = [words(rng, 4000), "", "x" * 9000 + " end", "é" * 3000 + " 日本 " * 900, words(rng, 3)]
    data, offs = common.utf8_parts(pseudolm.pa.array(texts))
    whole = common._word_hashes(data, offs)
    plain = [len(w) for w in whole]
    for size in (50, 1000, 5000):
        monkeypatch.setattr(common, "SLICE_BYTES", size)
        blocks = word_hashes(data, offs)
        assert [len(b) for b in blocks] == plain and all((a == b).all() for a, b in zip(whole, blocks))
    monkeypatch.undo()
    big = words(rng, 500_000)  # beyond two megabytes
    assert len(big) > 2 * common.SLICE_BYTES
    rows = [(1, big, "aa"), (2, "vwx yz zyx " * 5, "zz"), *((k, words(rng, 30), "aa") for k in range(10, 40)), *((k, "vwx zyx wv xy " * 4, "zz") for k in range(50, 80))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[1]["lang_pred"] == "aa" and got[2]["lang_pred"] == "zz"
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -1.0, 0.1)
    assert all(abs(r["score"] - 1 / (1 + np.e)) < 1e-9 for r in toxicity.score(df, model).collect())
    scored = {r["doc_id"]: r for r in pseudolm.score(df, pseudolm.fit(df, rounds=0)).collect()}
    assert scored[1]["n_tokens"] == 500_000 and scored[1]["pll"] < 0
    near = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame([(1, big), (2, big + " tail")], "doc_id bigint, text string")).collect()}
    assert near[2]["component_id"] == 1
    fp = {r["doc_id"]: r for r in fingerprints.compare_edited(df.where("doc_id < 3")).collect()}
    assert fp[1]["n_chars"] == len(big) and fp[1]["fingerprint"] == fingerprints.as_hex(fingerprints.fingerprint(big))
    lib = tokenizers.Tokenizer.from_file(PATH)
    ids = lib.encode(big, add_special_tokens=False).ids
    assert bpe.round_trip(df.where("doc_id = 1"), PATH).head()["n_tokens"] == len(ids)
    assert tokenfile.read_tokens(tokenfile.write_tokens(df.where("doc_id = 1"), PATH)).head()["ids_crc32"] == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_ties_and_repeats(spark):
    same = spark.createDataFrame([(k, "one and the same text", "aa" if k % 2 else "bb") for k in range(40)], "doc_id bigint, text string, lang string")
    got = langid.identify(same, langid.fit(same)).collect()
    assert len({(r["lang_pred"], r["score"]) for r in got}) == 1 and got[0]["lang_pred"] in ("aa", "bb")
    model = toxicity.fit(same, spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int"))
    assert len({r["score"] for r in toxicity.score(same, model).collect()}) == 1
    assert toxicity.fit(same, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")).prior == model.prior == 0.5
    scored = pseudolm.score(same, pseudolm.fit(same)).collect()
    assert len({r["pll"] for r in scored}) == 1
    tie = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2), np.ones(langid.BUCKETS, bool), 0.0, 0.0)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(same, tie).collect()} == {("aa", 0.5)}


def test_language(spark, odd, empty):
    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(k, make("abcde" if k % 2 else "vwxyz", rng.randint(5, 60)), "aa" if k % 2 else "zz") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 0"))
    got = langid.identify(df, model).collect()
    held = [r for r in got if r["doc_id"] % 3 == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97 and sum(r["rejected"] for r in got) <= 3
    und = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(und[k]["lang_pred"] == "und" and und[k]["rejected"] and und[k]["score"] == 0 for k in (1, 2, 3)) and und[6]["rejected"]
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        ws = words(rng, rng.randint(5, 60)).split()
        if k % 8 == 0:
            for _ in range(rng.randint(1, 4)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["nasty", "vile", "awful"]))
        rows.append((k, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(0, 900, 2)] + [(5000, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect() if r["doc_id"] % 5 == 0]
    bad, good = [s for k, s in got if k % 8 == 0], [s for k, s in got if k % 8]
    assert sum(s >= 0.5 for s in bad) / len(bad) > 0.8 and sum(s >= 0.5 for s in good) / len(good) < 0.05
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert max(r["score"] for r in toxicity.score(odd, toxicity.fit(empty, labels.limit(0))).collect()) < 0.5


def test_nonnegative_risk_and_its_step():
    rng = np.random.default_rng(8)
    for prior, shift in ((0.2, 0.0), (0.3, 2.0), (0.8, 6.0)):  # the last brings the corrected risk below zero
        zp, zu = rng.normal(shift, 1, 9), rng.normal(0, 1, 14) - 8 * (prior == 0.8)
        value, gp, gu = toxicity.risk(zp, zu, prior)
        loss = lambda z, y: np.logaddexp(0, -y * z).mean()
        negative = loss(zu, -1) - prior * loss(zp, -1)
        assert np.isclose(value, prior * loss(zp, 1) + max(0.0, negative))
        # the direction is the gradient of that risk, or, where the correction is below zero, of its opposite

        def objective(a, b):
            n = loss(b, -1) - prior * loss(a, -1)
            return prior * loss(a, 1) + n if negative >= 0 else -n

        for k in range(9):
            step = np.zeros(9)
            step[k] = 1e-6
            assert np.isclose((objective(zp + step, zu) - objective(zp - step, zu)) / 2e-6, gp[k], atol=1e-6)
        for k in range(14):
            step = np.zeros(14)
            step[k] = 1e-6
            assert np.isclose((objective(zp, zu + step) - objective(zp, zu - step)) / 2e-6, gu[k], atol=1e-6)
    assert negative < 0


def test_toxicity_by_hand(spark):
    rows = [(k, t) for k, t in enumerate(["bad egg", "good egg egg", "", None, "Bad, BAD day"])]
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -1.0, 0.1)
    bucket = lambda w: int(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) % toxicity.BUCKETS
    model.weight[bucket("bad")], model.weight[bucket("egg")] = 2.0, -0.5
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert np.allclose([got[k] for k in range(5)], 1 / (1 + np.exp(-np.array([0.5, -1.5, -1, -1, 1.0]))))
    held, n = toxicity.document_frequencies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert n == 5 and held[bucket("bad")] == 2 and held[bucket("egg")] == 2 and held.sum() == 6


def test_samples_stay_bounded_under_copies(spark):
    copies = spark.range(100_000).selectExpr("id doc_id", "if(id % 10 = 0, concat('text number ', id), 'one text of many') text", "if(id % 3 = 0, 'aa', 'bb') lang")
    assert 500 < langid.training_rows(copies, "text", "lang", 1000).count() < 1500
    assert 500 < toxicity._thinned(copies.withColumnRenamed("doc_id", "id"), 1000).count() < 1500
    one = spark.range(100_000).selectExpr("7L doc_id", "'the very same row' text", "'aa' lang")  # all drawn or none
    model = langid.fit(one, total=50)
    assert model.langs in (["aa"], [])
    assert toxicity.fit(one, spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int"), positives=40, unlabelled=40).prior in (0.0, 0.9)


def test_pseudo_likelihood_by_brute_force(spark, odd):
    """Every word's probability given the two before and the two behind it, with plain loops over a small model."""
    rng = random.Random(41)
    vocabulary = words(rng, 30).split()
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pseudolm.fit(df)
    tables, bias, wc, wm = (p.astype(float) for p in model.params)
    times = {}
    for _, t in rows:
        for w in t.split():
            times[w] = times.get(w, 0) + 1
    token = lambda w: int(model.tokens(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0])
    ids = {w: token(w) for w in times}
    assert len(set(ids.values())) == len(ids)  # each its own: no shares
    for r in pseudolm.score(df, model).collect():
        ws, total = dict(rows)[r["doc_id"]].split(), 0.0
        for k, w in enumerate(ws):
            hidden = bias.copy()
            for place, d in enumerate((-2, -1, 1, 2)):
                hidden += tables[place][ids[ws[k + d]] if 0 <= k + d < len(ws) else 0]
            hidden = np.append(np.tanh(hidden), 1)
            c, own = ids[w] % model.classes, ids[w] // model.classes
            for z, at in ((hidden @ wc, c), (hidden @ wm[c], own)):
                total += z[at] - np.log(np.exp(z).sum())
        assert r["n_tokens"] == len(ws) and abs(r["pll"] - total) < 1e-2


def test_pseudo_likelihood_steps_down_its_gradient():
    rng = np.random.default_rng(4)
    model = pseudolm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int32), [p.astype(np.float32) for p in pseudolm.initial()], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids = rng.integers(1, 1024, 40).astype(np.int32)
    around = model.contexts(ids, np.repeat([0, 1], 20))
    before = [p.copy() for p in model.params]
    loss = lambda params: -pseudolm.replace(model, params=params).log_probability(ids, around).mean()
    rate = 1e-3
    model.train_step(ids, around, rate)
    for which in (1, 2, 3):  # the step of bias and weights is 8 * rate * gradient
        moved = np.argwhere(model.params[which] != before[which])
        for at in map(tuple, moved[rng.choice(len(moved), 6, replace=False)]):
            up, down = ([p.astype(float) for p in before] for _ in range(2))
            up[which][at] += 1e-3
            down[which][at] -= 1e-3
            slope = (loss(up) - loss(down)) / 2e-3
            assert np.isclose((before[which][at] - model.params[which][at]) / (8 * rate), slope, rtol=0.05, atol=1e-4)
    assert loss(model.params) < loss(before)


def test_pseudo_likelihood_of_extreme_scores():
    model = pseudolm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int32), pseudolm.initial(), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(pseudolm.CLASSES**2 - 1 - pseudolm.own_ids(pseudolm.CLASSES), np.int64))
    model.params = [p * 1e4 for p in model.params]
    ids = np.arange(50, dtype=np.int32)
    assert np.isfinite(model.log_probability(ids, model.contexts(ids, np.zeros(50, np.int64)))).all()


def test_pseudo_likelihood(spark, odd, empty):
    rng = random.Random(9)
    vocabulary = words(rng, 40).split()
    text = lambda n: " ".join(vocabulary[(s := rng.randrange(40)) : s + 1][0] + " " + vocabulary[(s + 1) % 40] for _ in range(n))
    df = spark.createDataFrame([(k, text(120)) for k in range(400)], "doc_id bigint, text string")
    untrained, trained = pseudolm.fit(df, rounds=0), pseudolm.fit(df, rounds=2)
    mean = lambda m: pseudolm.score(df, m).agg({"mean_pll": "avg"}).head()[0]
    assert mean(trained) > mean(untrained) + 0.2
    got = {r["doc_id"]: r for r in pseudolm.score(odd, trained).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["pll"] == 0 and got[4]["n_tokens"] == 1 and got[5]["n_tokens"] == 2000 and got[5]["pll"] < 0
    assert pseudolm.score(empty, pseudolm.fit(empty)).count() == 0
    model = pseudolm.fit(df.limit(20), rounds=1)
    ids = np.array([3, 5, 7], np.int32)
    around = model.contexts(ids, np.array([0, 0, 1]))
    total = sum(np.exp(model.log_probability(np.full(3, k, np.int32), around)) for k in range(1024))
    assert np.allclose(total, 1, atol=1e-3)  # the two levels make one distribution


def test_pseudo_likelihood_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "COMMON", 900)  # the other counts are joined
    rng = random.Random(11)
    often = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.choices(often, [1 / (j + 20) for j in range(3000)], k=200))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pseudolm.fit(df, rounds=0)
    times = {}
    for _, t in rows:
        for w in t.split():
            times[w] = times.get(w, 0) + 1
    order = sorted(times, key=lambda w: times[w])
    assert model.rare.count() > 100
    # alone in a document every word has the same context: all counted words together have a probability below 1
    alone = spark.createDataFrame([(k, w) for k, w in enumerate([*order, "neverseen"])], "doc_id bigint, text string")
    got = [r["pll"] for r in sorted(pseudolm.score(alone, model).collect(), key=lambda r: r["doc_id"])]
    assert 0.9 < sum(np.exp(got[:-1])) <= 1.001
    ids = [int(model.tokens(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0]) for w in [*order, "neverseen"]]
    shared = 0
    for a, b in itertools.combinations(range(len(order)), 2):
        if ids[a] == ids[b]:  # words of one shared id differ by their counts alone
            shared += 1
            assert abs(got[b] - got[a] - np.log(times[order[b]] / times[order[a]])) < 1e-3
    assert shared > 500
    assert got[-1] <= max(g for g, k in zip(got, ids) if k == ids[-1])
    # and the ids grow with the different words
    assert pseudolm.classes_for(3000) == 32 and pseudolm.classes_for(286_327) > 40 and pseudolm.classes_for(10**8) > 180


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_pseudo_likelihood_trains_on_every_position(spark, monkeypatch, tmp_path, rounds):
    lengths = [1, 2, 3, 7, 30, 61]
    plain = pseudolm.Model.train_step

    def noted(self, ids, around, rate):
        (tmp_path / f"{random.SystemRandom().random()}").write_text(str(len(ids)))
        plain(self, ids, around, rate)

    monkeypatch.setattr(pseudolm.Model, "train_step", noted)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    seen = np.concatenate([pseudolm.turned(rows, k, rounds) for k in range(rounds)])
    assert sorted(seen.tolist()) == list(range(len(rows)))
    docs = [(b"w " * n).decode() for n in lengths]
    column = pseudolm.pa.RecordBatch.from_arrays([pseudolm.pa.array(docs)], ["text"])

    class Table:  # the tasks' function runs here, where it can be watched
        def __getattr__(self, name):
            return getattr(df, name)

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return spark.createDataFrame([tuple(r.values()) for b in run([column]) for r in b.to_pylist()], schema)

    df = spark.createDataFrame([(t,) for t in docs], "text string")
    model = pseudolm.fit(df, rounds=0)
    for k in range(rounds):
        pseudolm._round(Table(), model, "text", k, rounds)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == len(rows)


def _walked(text):
    """(steps, bits) of a whole walk, step by step."""
    chars = fingerprints.classes(text)
    at, step, bits = 0, 0, []
    while at < len(text):
        bits.append(fingerprints._BITS[step % fingerprints.PERIOD][chars[at]])
        at += int(fingerprints._WALK[step % fingerprints.PERIOD][chars[at]])
        step += 1
    return bits


def _estimate(a, b):
    """The weighted Hamming distance of two walks at the sampled steps, with plain loops."""
    differ = total = 0
    for level in range(40):
        weight = 1 if level == 0 else 1 << level - 1
        for step in fingerprints.places(level):
            if step < max(len(a), len(b)):
                total += weight
                differ += weight * (0.5 if step >= min(len(a), len(b)) else a[step] != b[step])
    return max(0.0, 1 - 2 * differ / total) if total else 1.0


def test_edit_embedding_against_plain_walks():
    rng = random.Random(60)
    texts = ["", "a", "ab", "é日本👍", *(words(rng, n) for n in (3, 9, 30, 200, 1500))]
    texts += [t[: len(t) // 3] + "X" + t[len(t) // 3 :] for t in texts]
    walks = [_walked(t) for t in texts]
    fps = [fingerprints.fingerprint(t) for t in texts]
    for t, w, f in zip(texts, walks, fps):
        steps = [s for level in range(20) for s in fingerprints.places(level) if s < len(w)]
        assert f[0] == len(steps) and [f[1] >> k & 1 for k in range(f[0])] == [w[s] for s in steps]
        assert fingerprints.from_hex(fingerprints.as_hex(f)) == f
    for (a, fa), (b, fb) in itertools.combinations(zip(walks, fps), 2):
        assert abs(fingerprints.likeness(fa, fb) - _estimate(a, b)) < 1e-12
        if max(len(a), len(b)) <= fingerprints.LEVEL and a != b:  # all steps are sampled: the Hamming distance itself
            hamming = sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)) / 2
            assert abs(fingerprints.likeness(fa, fb) - max(0.0, 1 - 2 * hamming / max(len(a), len(b)))) < 1e-12
    for t in texts:
        for after in ("", "zz", words(rng, 400)):
            own, new, changed = fingerprints.with_edited(t, after)
            assert new == fingerprints.edited(t, after) and own == fingerprints.fingerprint(t) and changed == fingerprints.fingerprint(new)


def test_few_edits_stay_near():
    rng = random.Random(64)
    for n in (120, 900):
        for _ in range(15):
            a, b = words(rng, n), words(rng, n)
            one = a[: len(a) // 2] + "?" + a[len(a) // 2 :]
            fa, fb, f1 = map(fingerprints.fingerprint, (a, b, one))
            assert fingerprints.compared(fa, f1) > 0.6 and fingerprints.compared(fa, fb) < 0.2
            half = fingerprints.fingerprint(fingerprints.edited(a, b))
            assert 0.3 < fingerprints.compared(fa, half) < 0.75


def test_edit_fingerprints(spark, odd, empty):
    found = fingerprints.compare_edited(odd, rows_per_bucket=2).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        new = fingerprints.edited(t, after)
        f, g, h = map(fingerprints.fingerprint, (t, new, after))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.as_hex(f), fingerprints.as_hex(g), fingerprints.compared(f, g), fingerprints.compared(f, h)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found)
    assert fingerprints.compare_edited(empty).count() == 0
    alone = fingerprints.compare_edited(odd.where("doc_id = 5")).collect()  # its own next document
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_near_pairs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 8)  # buckets are cut into pieces
    rng = random.Random(21)
    template = words(rng, 700)
    rows = []
    for k in range(60):  # a hot source: one template, changed in many places; id 0 is far from most
        t = template
        for _ in range(rng.randint(1, 12)):
            at = rng.randrange(len(t) - 60)
            t = t[:at] + words(rng, 6) + t[at + 30 :]
        rows.append((k, t))
    for k in range(40):  # texts of all lengths, each with a changed copy
        t = words(rng, 3 + k * k // 4)
        at = rng.randrange(len(t))
        rows += [(200 + 2 * k, t), (201 + 2 * k, t[:at] + "#" + t[at + 1 :])]
    rows += [(100, rows[3][1]), (101, ""), (102, None)]
    fps = {i: fingerprints.fingerprint(t) for i, t in rows}
    near = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if fingerprints.likeness(fps[a], fps[b]) >= 0.8}
    got = {(r["id_a"], r["id_b"]) for r in fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got <= near and len(near) > 60
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in got:
        up[root(a)] = root(b)
    met = [root(a) == root(b) for a, b in near]
    assert sum(met) >= 0.97 * len(met)  # recall against brute force
    assert all(root(a) == root(b) for a, b in near if fps[a] == fps[b])
    shared = [(a, b) for a, b in near if not set(fingerprints.bands(fps[a], 16)).isdisjoint(fingerprints.bands(fps[b], 16))]
    assert all(root(a) == root(b) for a, b in shared)  # whoever shares a band is compared
