import io
import json
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.operators import joins
from folioflow.sources import archive as A
from folioflow.sources import records as R


def zipped(members, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = more.get("mode", 0) << 16
            z.writestr(info, body)
    return out.getvalue()


GOOD = [("mimetype", b"application/epub+zip"), ("OEBPS/a.xhtml", b"<html/>"), ("OEBPS/b.css", b"x")]


@pytest.mark.parametrize(
    ("data", "reason"),
    [
        (zipped([("../x", b"")]), "path rejected"), (zipped([("/x", b"")]), "path rejected"), (zipped([("C:x", b"")]), "path rejected"), (zipped([("a", b""), ("A", b"")]), "duplicate"), (zipped([("a", b""), ("a/b", b"")]), "below a file"),
        (zipped([("a", b"0" * 100_000)]), "too compressed"), (zipped([("a", b"")], mode=stat.S_IFLNK | 0o777), "link or special"), (b"not a zip", "not a zip"), (zipped([("a", b"xy" * 600)]), "too large"), (zipped([(f"f{i}", b"") for i in range(20)]), "member count"),
    ],
)
def test_unsafe_archives(data, reason):
    with pytest.raises(A.UnsafeArchive, match=reason):
        A.read(data, A.Limits(members=10, member_bytes=1000 if reason == "too large" else 1 << 20))


def test_archives(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(A.packed(list(reversed(GOOD))))
    (tmp_path / "b.epub").write_bytes(b"broken")
    rows = A.members(spark, f"file://{tmp_path}").collect()
    assert sorted((r.member, bytes(r.content)) for r in rows if not r.error) == sorted(GOOD) and sum(bool(r.error) for r in rows) == 1
    with zipfile.ZipFile(tmp_path / "a.epub") as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_language(spark):
    assert spark.range(1).select(A.with_language(F.lit('<dc:language id="l">en</dc:language>'))).first()[0] == '<dc:language id="l">zh</dc:language>'


def test_tasks(spark, tmp_path):
    (tmp_path / "t1.json").write_text(json.dumps({"status": "done", "progress": 1.0}))
    (tmp_path / "t2.json").write_text(json.dumps({"task_id": "other", "status": "queued"}, indent=1))
    (tmp_path / "t1.audit.json").write_text("{}")
    got = R.tasks(spark, f"file://{tmp_path}")
    assert sorted((r.task_id, r.status) for r in got.collect()) == [("other", "queued"), ("t1", "done")]
    new = spark.createDataFrame([("t1", None, "late"), ("t3", "queued", None)], "task_id string, status string, error string")
    assert {r.task_id: (r.status, r.error) for r in R.updated(got, new).collect()} == {"t1": ("done", "late"), "other": ("queued", None), "t3": ("queued", None)}


def test_ledger_and_cache(spark, tmp_path):
    for i in range(2):
        R.append_ledger(spark.createDataFrame([(2, float(i), "m", 5)], "schema int, ts double, model string, prompt_tokens long"), f"file://{tmp_path}/ledger")
    assert R.ledger(spark, f"file://{tmp_path}/ledger").agg(F.sum("prompt_tokens")).first()[0] == 10
    rows = [(1, 1, "a" * 64, "x", "s", 2), (1, 1, "bad", "x", "s", 2), (1, 1, "b" * 64, "x", "t", 2), (1, 1, "c" * 64, "x", "s", 1)]
    R.save(spark.createDataFrame(rows, "doc_id long, page_no int, identity string, translation string, source_sha256 string, schema_version int"), f"file://{tmp_path}/cache", "doc_id")
    assert [r.identity[0] for r in R.page_cache(spark, f"file://{tmp_path}/cache", F.lit("s")).collect()] == ["a"]


def test_glossary(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({" Bank ": "银行", "Rate": "利率"}))
    docs = spark.createDataFrame([(1, "Rate of the Bank, the Bank Rate and Rate")], "doc_id long, text string")
    prompt = R.glossary_prompt(joins.glossary_hits(docs, R.glossary(spark, str(path))))
    assert prompt.first().glossary == "Rate = 利率\nBank = 银行"
    assert [r[0] for r in prompt.select(R.with_glossary(F.lit("P"), F.col("glossary"))).collect()] == ["P\n\nRate = 利率\nBank = 银行"]
    assert R.glossary(spark, None).count() == 0
    for bad in ("[1]", '{"a": 1}', '{"a": ""}', '{"a\\nb": "c"}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            R.glossary(spark, str(path))
    with pytest.raises(ValueError):
        R.glossary(spark, str(path), most_bytes=3)
    with pytest.raises(ValueError):
        R.glossary(spark, str(tmp_path / "none"))


def test_recognised_words(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = f'{head}\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t20\t40\t10\t8\t91.5\tThe\n5\t1\t1\t1\t1\t2\t20\t40\t10\t8\t12\t"odd\n'
    df = spark.createDataFrame([(1, 1, tsv)], "doc_id long, page_no int, tsv string")
    got = R.recognised_words(df, scale=2.0, least=30).collect()
    assert [(r.text, tuple(r.box)) for r in got] == [("The", (10.0, 20.0, 15.0, 24.0))]
    assert R.recognised_words(df).count() == 2
