"""The pipeline stage by stage against plain versions."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory, sf):
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{root}/{i}")
        out.append(spark.read.parquet(f"{root}/{i}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(staged):
    assert all(df.columns == staged[0].columns for df in staged[:-1])


def test_language_stage_keeps_readable_documents(staged):
    before, after = texts(staged[0]), texts(staged[1])
    assert set(before) - set(after) <= {i for i, t in before.items() if not any(map(str.isalpha, t or ""))}


def test_near_dedup_stage(staged):
    from tests.llm.test_simhash import closure, jaccard

    before, after = texts(staged[1]), texts(staged[2])
    ids = sorted(before)
    near = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if before[a] == before[b] or jaccard(before[a], before[b]) >= 0.8]
    assert set(after) == set(closure(ids, near).values())


def test_substring_stage(staged):
    from tests.llm.test_windows import brute

    before, after = staged[2], staged[3]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i: n - gone for i, n, gone, _, _ in brute(rows, 50, True)}
    got = texts(after)
    assert {i: len((t or "").encode().split()) for i, t in got.items()} == want
    assert all(got[i] == t for i, t in rows if len((t or "").encode().split()) == want[i])


def test_decontamination_stage(staged, spark, sf):
    from tests.llm.test_others import best_windows

    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = texts(staged[3]), texts(staged[4])
    held = {i for i, t in before.items() if any(best_windows((t or "").lower().split(), x)[0] >= 0.8 for x in items)}
    assert held and set(before) - set(after) == held


def test_encoding_stage(staged):
    import tiktoken

    from graphloom.llm.bpe import ByteBPE

    ranks = ByteBPE.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = texts(staged[4])
    got = {r["doc_id"]: r["token_ids"] for r in staged[5].collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in text.items()}


def test_run_equals_the_stages(staged, spark, sf):
    assert {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, sf).collect()} == {r["doc_id"]: r["n_tokens"] for r in staged[5].collect()}


def test_stages_take_empty_tables(staged, spark, sf):
    for _, stage in pipeline.STAGES:
        assert stage(spark, staged[0].limit(0), sf).count() == 0
