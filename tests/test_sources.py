from averis.sources import readers as R
from averis.sources import writers as W


def test_case_corpus_round_trip(spark, tmp_path):
    base = tmp_path / "original" / "diy" / "training" / "[N] Ann vs. Bob"
    base.mkdir(parents=True)
    (base / "known Ann - aaaaaaaaaaa.txt").write_bytes("grün".encode("cp1252"))
    (base / "known Ann - bbbbbbbbbbb.txt").write_text("zwei")
    (base / "unknown Bob - ccccccccccc.txt").write_text("drei")
    (base.parent / "[Y] Solo vs. Solo").mkdir()
    (base.parent / "[Y] Solo vs. Solo" / "known x.txt").write_text("x")
    r = R.case_corpus(spark, str(tmp_path)).collect()
    assert len(r) == 1
    assert (r[0].masking, r[0].topic, r[0].split, r[0].known, r[0].unknown, r[0].label) == ("original", "diy", "train", "grün zwei", "drei", 0)
    assert [x.line for x in R.truth_lines(R.case_corpus(spark, str(tmp_path))).collect()] == ["[N] Ann vs. Bob N"]


def test_transcripts_and_lists(spark, tmp_path):
    (tmp_path / "math").mkdir()
    (tmp_path / "math" / "A - B - abcdefghijk.txt").write_text("t")
    (tmp_path / "math" / "plain.txt").write_text("t")
    got = {(r.author, r.video_id) for r in R.transcripts(spark, str(tmp_path)).collect()}
    assert got == {("A - B", "abcdefghijk"), ("plain", None)}
    assert R.transcripts(spark, str(tmp_path), strict=True).count() == 1
    f = tmp_path / "list.tsv"
    f.write_text("# c\n\nIm\tin dem\nsolo\n")
    assert [tuple(r) for r in R.contraction_list(spark, str(f)).collect()] == [("im", "in dem")]
    assert {r.word for r in R.word_list(spark, str(f)).collect()} == {"im\tin dem", "solo"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 0.123456)], "topic string, acc double")
    W.append_results(df, str(tmp_path / "r"))
    W.append_results(df, str(tmp_path / "r"))
    assert [r.acc for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [0.1235, 0.1235]
    assert "**" in W.matrix_text([("a", "b", "**")], {"a": 0.5, "b": 0.6}) and "b (0.600)" in W.matrix_latex([("a", "b", "**")], {"a": 0.5, "b": 0.6})


def test_json_lists(spark, tmp_path):
    f = tmp_path / "lists.json"
    f.write_text('{"words": ["The", "of "], "phrases": ["in fact"]}')
    assert {tuple(r) for r in R.json_word_lists(spark, str(f)).collect()} == {("words", "the"), ("words", "of"), ("phrases", "in fact")}
    f.write_text('{"contractions": [["I\'m", "don\'t", "odd"], ["I am", "do not"]], "other": [["x"]]}')
    assert {tuple(r) for r in R.json_contractions(spark, str(f)).collect()} == {("i'm", "i am"), ("don't", "do not")}
