import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from moorage.plans import organize, provider, registry
from moorage.sources import containers, ingest
from moorage.streaming import streams

REPORT = """시간제 근무 보고서
storeName: 바다책방
shiftPeriod: 2024-03 ~ 2024-08
station: 계산대
contract: 하루제
핵심 성과: 응답 시간을 820ms 에서 210ms 로 줄이고 250팀 대회를 운영
duties[0].duty: 주문 처리
duties[1].duty: 포장
duties[1].note: 하루 40상자
맡은 일은 주문 처리 손보기였다.
"""


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_ingest(spark, tmp_path):
    docx = zipped({"word/document.xml": "<w:p>문서 본문입니다</w:p>"})
    pptx = zipped({"ppt/slides/slide2.xml": "<a:p>둘</a:p>", "ppt/slides/slide1.xml": "<a:p>하나</a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p>노트</a:p>"})
    xlsx = zipped({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>항목</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></w>'})
    files = {
        "a.md": "# 제목\n본문", "b.csv": "항목,수치\n전환율,12%", "c.html": "<p>보임</p><script>숨김</script>", "d.docx": docx, "e.pptx": pptx, "f.xlsx": xlsx, "g.zip": zipped({"in/x.txt": "안쪽", "__MACOSX/y": "z", "deep.zip": zipped({"y.txt": "더 안쪽"})}),
        "h.bin": b"\x00\x01\x02\x03\x04", "i.eml": "Subject: Hi\nFrom: a@b.example\n\n<p>Mail</p>", "j.txt": "한국어 문서".encode("cp949"), "k.zip": b"PK\x03\x04broken",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    got = {r.name: r for r in ingest.ingest(ingest.read_input_files(spark, [str(tmp_path)])).collect()}
    assert got["a.md"].text == "# 제목\n본문" and got["a.md"].kind == "text"
    assert "항목: 전환율 | 수치: 12%" in got["b.csv"].text
    assert got["c.html"].text == "보임"
    assert got["d.docx"].text == "문서 본문입니다"
    assert got["e.pptx"].text == "[슬라이드 1]\n하나\n[발표자 노트]\n노트\n\n[슬라이드 2]\n둘"
    assert got["f.xlsx"].text == "[시트: S]\n항목 |  | 3"
    assert got["g.zip/in/x.txt"].text == "안쪽" and got["g.zip/deep.zip/y.txt"].text == "더 안쪽" and "g.zip" not in got
    assert got["h.bin"].kind == "unknown" and got["h.bin"].confidence == pytest.approx(0.1)
    assert got["i.eml"].metadata["subject"] == "Hi" and got["i.eml"].text.endswith("Mail")
    assert got["j.txt"].text == "한국어 문서" and got["j.txt"].metadata["encoding"] == "cp949"
    assert got["k.zip"].confidence <= 0.15 and got["k.zip"].warnings
    assert len(got) == 12
    (tmp_path / "many.zip").write_bytes(zipped({f"f{i:02}.txt": f"text {i}" for i in range(45)}))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x01\x40\x00\x00\x00\xf0\x08")
    more = ingest.ingest(ingest.read_input_files(spark, [str(tmp_path / "many.zip"), str(tmp_path / "p.png")])).collect()
    assert len(more) == 41 and sum("only the first 40" in " ".join(r.warnings) for r in more) == 1
    assert next(r for r in more if r.kind == "image").metadata["size"] == "320x240"
    ids = [r.source_id for r in ingest.read_input_files(spark, [str(tmp_path)]).orderBy("name").collect()]
    assert ids == [f"src{i + 1}" for i in range(13)]
    empty = spark.createDataFrame([("src1", "l.txt", None, bytearray(), None)], ingest.FILE)
    assert ingest.ingest(empty).first().confidence == 0
    assert {r.kind for r in ingest.totals(ingest.ingest(ingest.read_input_files(spark, [str(tmp_path / "a.md")]))).collect()} == {"text"}


def test_html_document_keeps_links():
    text = containers.html_document('<p>A</p><svg>x</svg><a href="/u">go</a><a href="/v"></a>')
    assert text == "Ago\n\n[링크]\ngo → /u"


DOC = "draft_id int, source_id string, name string, kind string, text string"


def test_organize(spark):
    docs = spark.createDataFrame([(1, "src1", "report.md", "text", REPORT), (2, "src1", "visit.txt", "text", "여행 기록\nplaceName: 강릉\n다녀온 곳 강릉 바다\nvisitPeriod: 2024-06")], DOC)
    result = organize.organize(spark, docs)
    assert {r.draft_id: r.type_id for r in result.types.collect()} == {1: "work.shift", 2: "trip.visit"}
    leaves = {r.path: r.value for r in result.leaves.where("draft_id = 1").collect()}
    assert leaves["storeName"] == "바다책방" and leaves["keyAchievement"].startswith("응답 시간")
    assert leaves["duties[0].duty"] == "주문 처리" and leaves["duties[1].duty"] == "포장" and leaves["duties[1].note"] == "하루 40상자"
    issues = {(r.path, r.rule) for r in result.issues.where("draft_id = 1").collect()}
    assert ("contract", "V04") in issues and ("title", "V01") in issues and ("storeName", "V01") not in issues
    assert not any(rule in ("G07 quote", "G07 number") for _, rule in issues)
    done = {r.draft_id: r.completeness for r in result.completeness.collect()}
    assert all(0 < c < 100 for c in done.values()) and len(done) == 2
    form = organize.form_state(spark, result).where("draft_id = 1").orderBy("at", "row", "inner").collect()
    assert [r.path for r in form][:2] == ["title", "summary"] and {r.path for r in form if r.filled} == set(leaves)
    assert [r.path for r in form if r.key == "duties"] == ["duties", *[f"duties[{i}].{k}" for i in (0, 1) for k in ("duty", "note", "result")]]
    assert not any(r.template for r in form)
    spans = {r.draft_id: r.evidence for r in result.evidence.collect()}
    assert "820ms" in spans[1] and "강릉" in spans[2]
    patch = spark.createDataFrame([(1, "keyAchievement", "999팀이 참여"), (1, "station", None)], "draft_id int, path string, value string")
    second = organize.organize(spark, docs, patch=patch)
    assert ("keyAchievement", "G07 number") in {(r.path, r.rule) for r in second.issues.collect()}
    assert "station" not in {r.path for r in second.leaves.collect()}


def test_drafts_are_merged_and_reviewed(spark):
    docs = spark.createDataFrame([(1, "src1", "a.txt", "text", "매장에서 교대 근무를 했다. 하늘가게 에서 2024-03 부터 일했다. 포장 40상자, 계산 12시간을 맡았다."), (2, "src1", "b.txt", "text", "교대 근무. 바다가게 에서 일했다.")], DOC)
    said = [
        (1, 0, 0, "storeName", "하늘가게", 0.9, "하늘가게 에서 2024-03 부터 일했다"), (1, 1, 0, "storeName", "구름가게", 0.9, "구름가게 에서 오래 일하며 상을 받았다"),
        (1, 0, 1, "crew", "없는 사람 77명", 0.9, "없는 사람 77명이 함께 일한 매장의 긴 이야기"), (1, 0, 2, "duties[0].duty", "포장", 0.9, "포장 40상자"), (1, 1, 1, "duties[0].duty", "포장 ", 0.9, "포장 40상자"), (1, 1, 2, "duties[0].note", "40상자", 0.9, "포장 40상자"),
        (1, 1, 3, "duties[1].duty", "계산", 0.9, "계산 12시간을 맡았다"), (2, 0, 0, "storeName", "바다가게", 0.9, "바다가게 에서 일했다"), (2, 1, 0, "storeName", "바다가게 본점", 0.9, "바다가게 에서 일했다"),
    ]
    drafts = spark.createDataFrame(said, "draft_id int, draft int, ord int, path string, value string, confidence double, quote string")
    result = organize.organize(spark, docs, drafts=drafts)
    leaves = {(r.draft_id, r.path): r.value.strip() for r in result.leaves.collect()}
    assert leaves == {(1, "storeName"): "하늘가게", (1, "duties[0].duty"): "포장", (1, "duties[0].note"): "40상자", (1, "duties[1].duty"): "계산", (2, "storeName"): "바다가게"}
    assert {(r.draft_id, r.key) for r in result.conflicts.collect()} == {(2, "storeName")}
    assert {r.draft_id: r.verdict for r in result.verdicts.collect()} == {1: "revise", 2: "revise"}
    assert not any(r.rule in ("G07 quote", "G07 number") for r in result.issues.collect())
    form = {r.path: r for r in organize.form_state(spark, result).where("draft_id = 2").collect()}
    assert form["duties[].duty"].template and not form["duties[].duty"].filled and form["storeName"].filled


def test_provider(spark):
    requests = spark.createDataFrame([("1", "s", "ping", 0.0), ("2", "s", "unknown", 0.0)], "request_id string, stage string, prompt string, temperature double")
    got = {r.request_id: r for r in provider.ask(requests, provider.Recorded({"ping": json.dumps({"a": 1})})).collect()}
    assert got["1"].answer == '{"a": 1}' and got["1"].error is None and got["2"].error.startswith("KeyError")
    tries = []

    def fails():
        tries.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        provider.with_retry(fails, waits=[0, 0, 0])
    assert len(tries) == 4
    tries.clear()
    with pytest.raises(ValueError):
        provider.with_retry(fails, retryable=lambda e: False, waits=[0, 0, 0])
    assert len(tries) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Document {i % 5} says hello {i % 5}", f"2024-01-01 0{i % 3}:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    folder = str(tmp_path / "in")
    df.repartition(4).write.parquet(folder)

    def run(stream, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    source = streams.document_stream(spark, folder, df.schema, 1)
    assert sorted(run(streams.token_counts(source), "counts").collect()) == sorted(streams.token_counts(df).collect())
    new = run(streams.new_documents(source, "ts", "5 hours"), "new")
    assert new.count() == 5 and new.select("text").distinct().count() == 5


def test_every_query_has_a_name_and_sql_names_exist():
    assert set(registry.oracle_sql()) <= set(registry.queries())
