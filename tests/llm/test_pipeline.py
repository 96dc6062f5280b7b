import random

import pytest

pytest.importorskip("factweave.llm")
pytest.importorskip("public_tokenizers")


def test_pipeline_catches_what_is_planted(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(30)) for k in range(4)]
    rows = [(k, text(150)) for k in range(60)]
    passage = text(60)
    rows += [(60, rows[0][1]), (61, text(80) + " " + items[2][1] + " " + text(80)), (62, text(70) + " " + passage), (63, text(70) + " " + passage), (64, None), (65, "123 456 !!"), (66, "")]
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(out) & {60, 61, 64, 65, 66} and set(range(60)) <= set(out)
    assert out[62]["text"].endswith(passage) and len(out[63]["text"]) < len(out[62]["text"]) - 200
    assert all(r["text"] == r["decoded"] and r["n_tokens"] == len(r["token_ids"]) and r["n_chars"] == len(r["text"]) for r in out.values())


def test_near_duplicates_are_verified(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from factweave.llm import simhash, verified

    monkeypatch.setattr(verified, "BLOCK", 16)  # buckets are cut into pieces
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfghlmnprstaeiou") for _ in range(6))
    texts = []
    for _ in range(40):  # pairs at all similarities
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 8):
            other = list(base)
            for at in rng.sample(range(200), changes):
                other[at] = word()
            texts.append(" ".join(other))
    base = [word() for _ in range(120)]  # one template, many distinct fillings
    for _ in range(60):
        other = list(base)
        other[rng.randrange(120)] = word()
        texts.append(" ".join(other))
    # unrelated short texts within 7 bits of each other
    seen: dict[int, str] = {}
    while True:
        t = " ".join(word() for _ in range(6))
        f = simhash.fingerprint(t, 5)
        near = next((s for g, s in seen.items() if (f ^ g).bit_count() <= 7), None)
        if near:
            texts += [near, t]
            break
        seen[f] = t
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = {k for k in range(len(texts)) if root(k) == k}
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (900, texts[0])], "doc_id bigint, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert {len(texts) - 1, len(texts) - 2} <= set(got)  # unrelated texts stay
    assert want <= set(got) and None in got and 900 not in got  # nothing that isn't verified goes
    assert len(set(got) - {None} - want) <= 1  # the search meets 99.94 % of the pairs at 0.8


ROWS = [(1, None), (2, ""), (3, " \n "), (4, "12 34"), (5, "ein kurzer Text"), (6, "ein kurzer Text"), (6, "ein kurzer Text"), (7, "x" * 700), (None, "ohne Nummer, aber mit Text"), (None, None), (8, "日本語のテキスト 🙂 " * 30)]
EXTRA = "lang string, source string, n_chars bigint, __id bigint, __c bigint, lang_pred string, score double, __rejected boolean, token_ids string, `a b` int, doc string, key string"


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, "de", "s", len(t or ""), 3, 4, "zz", 0.5, True, "old", 7, "d", "k") for i, t in rows], "doc_id bigint, text string, " + EXTRA)


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path, at):
    import corpus_pipeline

    spark.createDataFrame([(1, "a passage of the benchmark that is quite long and has more than fifteen words in it for sure"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    docs = _documents(spark, ROWS)
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    if at < 4:
        assert out.columns == docs.columns
        assert all((r["__id"], r["__c"], r["lang_pred"], r["score"], r["__rejected"], r["a b"], r["doc"], r["key"]) == (3, 4, "zz", 0.5, True, 7, "d", "k") for r in rows)
    if at == 0:
        assert not {1, 2, 3, 4} & set(ids) and {7, 8} <= set(ids)
    if at == 1:
        assert ids == sorted([1, 4, 5, 7, 8, None, None], key=repr)  # 2 and 3 have no word, like 1; 6 is 5 again
    if at == 2:  # the empty text goes; 7 repeats itself from the second byte on
        assert ids == sorted([1, 3, 4, 5, 6, 6, 7, 8, None, None], key=repr) and next(r for r in rows if r["doc_id"] == 7)["n_chars"] == 1
    if at == 3:
        assert len(rows) == len(ROWS)
    if at == 4:
        assert len(rows) == len(ROWS) and all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) for r in rows)
        assert set(out.columns) == {*docs.columns, "decoded", "n_tokens"}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    _documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_takes_a_text_beyond_a_megabyte(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long, passage = text(250_000), text(30)
    assert len(long) > 1 << 20
    rows = [(k, text(80)) for k in range(1, 30)] + [(40, long), (41, long + " end"), (42, text(60_000) + " " + passage)]
    spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(1, 30), 40} and out[40]["decoded"] == long
