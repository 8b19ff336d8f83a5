"""Every stage on its own input against plain versions, and the hand-made cases through all of them."""

from array import array

import brute
import corpus_pipeline as pipeline
import pytest
from tables import PATH, rows

from groveflow.llm import bpe
from groveflow.session import materialise


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, PATH))
        seen.append(docs.collect())
    return seen


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    assert all(r.__fields__ == stages[0][0].__fields__ for s in stages[:-1] for r in s[:1])


def test_language_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages[1]}
    lost = [r for r in stages[0] if r.doc_id not in kept]
    assert len(lost) <= 2 and all(tuple(r) in {tuple(x) for x in stages[0]} for r in stages[1])


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1]]
    assert sorted(r.doc_id for r in stages[2]) == sorted({c for *_, c in brute.similar(before)})


def test_contaminated_documents_go(stages):
    judged = {r[0]: r[-1] for r in brute.decontaminate([(r.doc_id, r.text) for r in stages[2]], rows("benchmark", "item_id"))}
    assert {r.doc_id for r in stages[3]} == {d for d, bad in judged.items() if not bad}


def test_personal_data_are_replaced(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert len(stages[4]) == len(before)
    for r in stages[4]:
        found = brute.personal(before[r.doc_id].text)
        if not found:
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text) and all(before[r.doc_id].text[a:b] not in r.text for a, _, b, _ in found)


def test_tokens_round_trip(stages):
    own = bpe.encoder(bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in stages[4]}
    for r in stages[5]:
        ids = bytes(r.ids)
        assert ids == own.encoded(texts[r.doc_id]) and r.n_tokens == len(ids) // 4 and r.decoded_sha256 == brute.sha(own.decode(array("I", ids)))


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, PATH).collect())) == sorted(map(tuple, stages[5]))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, key string, score double, spans string"
HAND = [
    (1, None, None, "s", 0, 1, "k", 0.5, None),
    (1, None, None, "s", 0, 1, "k", 0.5, None),
    (None, "the the of and in", "en", None, 3, 1, None, None, None),
    (5, "the the of and in", "en", "a", 3, 2, "k", 1.0, "s"),
    (5, "the the of and in", "en", "a", 3, 2, "k", 1.0, "s"),
    (7, "mail a.b@c.de now", "en", "a", None, 2, "k", 1.0, "s"),
    (8, "", "en", "a", 0, 2, "k", 1.0, "s"),
]


def test_hand_cases(spark):
    docs = spark.createDataFrame(HAND, COLUMNS)
    ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0) for r in d.collect())
    first = pipeline.identify_language(spark, docs, PATH)
    assert ids(first) == [(False, 5), (False, 5), (False, 7), (True, 0)] and first.columns == docs.columns
    second = pipeline.drop_near_duplicates(spark, docs, PATH)
    assert ids(second) == [(False, 1), (False, 1), (False, 5), (False, 7), (False, 8)] and second.columns == docs.columns
    third = pipeline.drop_contaminated(spark, docs, PATH)
    assert sorted(map(str, third.collect())) == sorted(map(str, docs.collect()))
    fourth = pipeline.redact_personal(spark, docs, PATH)
    assert {(r.text, r.n_chars) for r in fourth.collect() if r.doc_id == 7} == {("mail <email> now", 16)} and fourth.columns == docs.columns
    assert len(pipeline.encode_tokens(spark, docs, PATH).collect()) == len(HAND)


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, PATH).collect() == []
