"""Encodings, workbooks, and scans of files with small and large libraries."""

import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmark.functions.fixed import BUILTIN_RULES
from siftmark.functions.hashing import simhash
from siftmark.operators import scanning
from siftmark.sources import encodings, extract

CHINESE = "客户名称：四川示例科技有限公司，联系人：张三，报价：50万元。合同金额和付款节点见附件，保密协议不得披露。"
TAIWAN = "客戶名稱：台北示例科技有限公司，聯絡人：陳小明，報價：五十萬元。合約金額與付款時間請見附件，保密協議不得揭露。"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32"])
@pytest.mark.parametrize("text", ["password = hunter2222\nplain", CHINESE + "\nline two", "Grüße aus Köln, señor\n"])
def test_unicode(text, encoding):
    assert encodings.decoded(text.encode(encoding)) == (text, None)


@pytest.mark.parametrize(("text", "encoding"), [(CHINESE, "gb18030"), (CHINESE[:12], "gbk"), (TAIWAN, "big5"), ("Die Größe der Straße ist über 5 m, schöne Grüße", "cp1252"), ("El niño comió piñas; ¿qué más quería? ¡Sí!", "latin-1"), ("L’été dernier, « garçon » à 5 €", "cp1252")])
def test_default_models(text, encoding):
    assert encodings.decoded(text.encode(encoding)) == (text, None)


def test_odd_bytes():
    assert encodings.decoded(b"") == ("", None)
    assert encodings.decoded(b"a\x00b") == ("a\x00b", None)
    text, error = encodings.decoded(b"abc \x81 def \xff\xff\x81")
    assert error == "no known encoding" and text.startswith("abc ")
    assert encodings.decoded(b"\xff\xfea")[1].startswith("utf-16")


def test_round_trips_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    models = encodings.fitted_to(docs.where("doc_id % 3 = 0"))
    tried = Counter()
    right = Counter()
    for r in docs.where("doc_id % 3 != 0").collect():
        for e in ("utf-8", "utf-16", "utf-16-le", "utf-16-be", "cp1252", "gb18030", "big5"):
            try:
                data = r.text.encode(e)
            except UnicodeEncodeError:
                continue
            tried[e] += 1
            right[e] += encodings.decoded(data, models)[0] == r.text
        for e, text in (("gb18030", CHINESE), ("big5", TAIWAN)):  # Chinese texts with a document's words between
            tried[e] += 1
            mixed = text.join(w for w in r.text.split()[:20] if w.isascii())
            right[e] += encodings.decoded(mixed.encode(e), models)[0] == mixed
    assert all(right[e] > 0.99 * n for e, n in tried.items()), (right, tried)


def book(order):
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in order)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="x"><sheets>' + "".join(f'<sheet name="s" r:id="r{i}"/>' for i in order) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        for i in sorted(order):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet><sheetData><row><c><v>{i}</v></c></row></sheetData></worksheet>")
    return data.getvalue()


def test_sheets_in_the_workbook_s_order():
    assert extract.xlsx(book([1, 2, 10])) == "1\n2\n10" and extract.xlsx(book([10, 1, 2])) == "10\n1\n2"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in (10, 1, 2):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet><row><c><v>{i}</v></c></row></worksheet>")
    assert extract.xlsx(data.getvalue()) == "1\n2\n10"


def test_files_with_a_large_library_equal_those_with_a_small_one(spark, monkeypatch):
    rows = [(f"{i}.txt", f"mail a{i % 7}@b.cd 13800138000 text number {i % 40} the License".encode(("utf-8", "utf-16")[i % 2])) for i in range(120)] + [("broken.zip", b"PK\x03\x04"), ("sealed.docx", b"x"), ("n", None)]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    known = files.where("path IN ('3.txt', '8.txt', 'broken.zip', 'sealed.docx')")
    prints = known.select(F.concat(F.lit("s"), "path").alias("sensitive_file_id"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("simhash")).unionByName(files.limit(1).select(F.lit("z").alias("sensitive_file_id"), F.lit("0" * 64).alias("sha256"), simhash(F.lit("mail text number 1 the License")).alias("simhash")))
    rules = [{"rule_id": n, "rule_type": "regex", "sensitive_type": n, "risk_level": r, "content": {"name": n, "pattern": p}} for n, p, r in BUILTIN_RULES]
    labels = spark.createDataFrame([("s1", ["licenses"], "e")], "sensitive_file_id string, semantic_labels array<string>, embedding_id string")
    lib = scanning.Library(rules, prints, labels, hints={"licenses": ["License"]})
    plain = Counter(tuple(r) for r in scanning.scan_files(files, lib).collect())
    assert sum(n for r, n in plain.items() if r[5] in ("s3.txt", "s8.txt")) >= 2
    seen = []
    monkeypatch.setattr(scanning.match, "materialise", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    monkeypatch.setattr(scanning, "MOST_HASHES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert Counter(tuple(r) for r in scanning.scan_files(files, lib).collect()) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (plan,) = seen
    joins = plan[plan.index("SortMergeJoin") : plan.index("MapInArrow")]
    assert "content" not in joins and "Exchange hashpartitioning(sha256" in joins
