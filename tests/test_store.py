"""The store, the file source, rule generation and the command line on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmark import cli
from siftmark.functions.fixed import BUILTIN_RULES, UNCLASSIFIED
from siftmark.operators import generate, scanning
from siftmark.operators.store import Conflict, Store
from siftmark.sources import extract
from siftmark.sources.files import read_tree

SAMPLE = "客户名称：四川示例科技有限公司\n联系人：张三 电话 13800138000\n邮箱 test@example.com 报价：50万元\napi_key = abcdefghijklmnop\n"
UPLOAD = "file_name string, content binary, sensitive_type string, risk_level string, description string"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in files.items():
            z.writestr(n.replace("__", "/"), x)
    return out.getvalue()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/server")
    rows = [("customer.txt", SAMPLE.encode(), "客户资料", " HIGH ", "客户报价"), ("blank.bin", b" \x00 ", None, None, None)]
    version, bad = s.ingest(spark.createDataFrame(rows, UPLOAD))
    assert version == 1 and bad.isEmpty()
    return s


def test_ingest(spark, store):
    rules = store.table("rules").where("source = 'sample'").collect()
    names = {json.loads(r.content).get("name") for r in rules if r.rule_type == "regex"}
    assert {"mobile_phone", "email", "api_key", "money_wan"} <= names
    words = next(json.loads(r.content)["keywords"] for r in rules if r.rule_type == "keyword" and r.sensitive_type == "客户资料")
    assert {"联系人", "报价"} <= set(words) and len(words) <= 12
    assert sum(r.rule_type == "combined" and r.sensitive_type == "客户资料" for r in rules) == 1
    assert {r.risk_level for r in rules if r.sensitive_type == "客户资料"} == {"high"}
    blank = store.table("samples").where("file_name = 'blank.bin'").first()
    assert blank.text == "[二进制文件: blank.bin, 大小: 3 bytes]" and blank.risk_level == "medium"
    assert store.table("rules").where("source = 'builtin'").count() == len(BUILTIN_RULES)


def test_duplicates_reject_the_whole(spark, store):
    rows = [("new.txt", b"brand new", "t", "low", ""), ("copy.txt", SAMPLE.encode(), "t", "low", ""), ("z.txt", b"brand new", "t", "low", ""), ("../up.txt", b"x", "t", "low", ""), ("void.txt", b"", "t", "low", "")]
    version, bad = store.ingest(spark.createDataFrame(rows, UPLOAD))
    assert version is None and store.version() == 1 and store.table("samples").count() == 2
    assert {(r.file_name, r.reason) for r in bad.collect()} == {("copy.txt", "existing_sample"), ("z.txt", "request_duplicate"), ("../up.txt", "bad_name"), ("void.txt", "empty")}


def test_lookups(store):
    sha = store.table("fingerprints").orderBy(F.desc("text_length")).first().sha256
    assert store.lookup_hash(sha).first().file_name == "customer.txt" and store.lookup_hash("0").isEmpty()
    assert store.query_file(file_hash=sha).first().match_type == "sha256"
    assert store.query_file(file_path="/x/CUSTOMER.txt").first().match_type == "filepath_basename_like"
    assert not store.query_file(file_name="100%").first().sensitive
    with pytest.raises(ValueError):
        store.query_file()
    assert store.find_samples("示例科技").count() == 1 and store.find_samples(risk="low").isEmpty() and store.list_samples().count() == 2


def test_rules_and_sync(store):
    rule = store.table("rules").where("source = 'sample'").first().rule_id
    assert store.update_rule(rule, content={"keywords": ["x"]}) == 2
    assert store.delete_rule(rule) == 3 and store.update_rule("builtin_domain", enabled=False) == 4
    got = store.sync(2)
    assert {r.rule_id for r in got["deleted"].collect()} == {rule, "builtin_domain"} and got["version"] == 4 and not got["full_sync"]
    assert got["rules"].count() == len(BUILTIN_RULES) - 1 and got["fingerprints"].isEmpty() and store.sync(0)["fingerprints"].count() == 2
    assert [("full_sync" in x, x["sensitive_type"]) for x in store.sync_batch([(0, "a"), (4, "b")])] == [(False, "a"), (False, "b")]
    with pytest.raises(KeyError):
        store.delete_rule("none")


def test_a_late_commit_fails(spark, store):
    """Two writers start from one snapshot: the second fails, and nothing of it is seen."""
    other = Store(spark, store.root)
    snap = other.manifest()
    edited = other.table("rules", snap).where("rule_id != 'builtin_email'")
    assert store.update_rule("builtin_domain", enabled=False) == 2
    with pytest.raises(Conflict):
        other.commit(snap, {"rules": edited}, "rule_update", library_version=snap["version"] + 1)
    assert store.version() == 2 and not store.table("rules").where("rule_id = 'builtin_domain'").first().enabled
    assert store.table("rules").where("rule_id = 'builtin_email'").count() == 1


def test_two_writers_at_once(spark, store):
    """Both change a rule in threads; each change that was reported stands, under a version of its own."""
    from concurrent.futures import ThreadPoolExecutor

    def change(rule):
        try:
            return Store(spark, store.root).update_rule(rule, risk_level="critical")
        except Conflict:
            return None

    rules = ["builtin_email", "builtin_domain", "builtin_passport", "builtin_address"]
    with ThreadPoolExecutor(4) as pool:
        got = dict(zip(rules, pool.map(change, rules), strict=True))
    done = [v for v in got.values() if v is not None]
    assert done and len(set(done)) == len(done)
    held = {r.rule_id: (r.risk_level, r.version) for r in store.table("rules").where(F.col("rule_id").isin(rules)).collect()}
    assert all((held[r] == ("critical", v)) if v else held[r][0] != "critical" for r, v in got.items())


def test_opening_seeds_missing_rules_only(spark, store):
    store.update_rule("builtin_email", risk_level="low")
    snap = store.manifest()
    store.commit(snap, {"rules": store.table("rules", snap).where("rule_id != 'builtin_domain'")}, "test")
    again = Store(spark, store.root)
    assert again.table("rules").where("rule_id = 'builtin_domain'").count() == 1 and again.table("rules").where("rule_id = 'builtin_email'").first().risk_level == "low"
    before = again.manifest()["commit"]
    assert Store(spark, store.root).manifest()["commit"] == before


def test_many_commits_are_rewritten(spark, store, monkeypatch):
    from siftmark.operators import store as module

    monkeypatch.setattr(module, "MOST_FOLDERS", 3)
    for i in range(4):
        store.report(spark.createDataFrame([(f"p{i}", "h", True, "t", "high", "f1", 90, "sensitive", "{}")], "file_path string, file_hash string, sensitive boolean, sensitive_type string, risk_level string, sensitive_file_id string, match_score int, confidence_level string, match_detail string"), "h1", "/", "now")
    assert len(store.manifest()["tables"]["results"]) <= 3 and store.table("results").count() == 4


def test_embeddings_and_models(spark, store):
    rows = spark.createDataFrame([("a.txt", b"alpha text", "t", "low", ""), ("b.txt", b"beta words", "t", "low", "")], UPLOAD)
    reply = json.dumps({"semantic_labels": ["L"], "sensitive_type": "t", "risk_level": "high", "explanation": "e"})
    version, _ = store.ingest(rows, embed=lambda texts: [[1.0, 0.0] if "alpha" in t else None for t in texts], model="m", ask=lambda p: reply if "beta" in p else None)
    assert version == 2
    found = store.semantic_search([1.0, 0.1]).collect()
    assert [r.file_name for r in found] == ["a.txt"] and found[0].score > 0.9
    told = {r.sensitive_file_id: r for r in store.table("features").where("version = 2").collect()}
    assert sorted((r.model_name, r.embedding_id[:4]) for r in told.values()) == [("m", ""), ("rule-fallback", "emb_")]

    def broken(_):
        raise RuntimeError("no service")

    assert store.ingest(spark.createDataFrame([("c.txt", b"gamma", "t", "low", "")], UPLOAD), embed=broken, ask=broken)[0] == 3
    assert store.table("features").where("version = 3").first().embedding is None


def test_config_reaches_hosts(spark, store, tmp_path):
    store.set_config(simhash_threshold=5, semantic_label_hints={"x": ["y"]})
    local = Store(spark, f"{tmp_path}/host")
    cli.sync(local, store)
    made = cli.library_of(local)
    assert (made.threshold, made.hints) == (5, {"x": ["y"]})


def test_batch_limits(spark, store):
    rows = [(f"{i}.txt", f"text {i}".encode(), "t", "low", "") for i in range(51)]
    with pytest.raises(ValueError):
        store.ingest_batch(spark.createDataFrame(rows, UPLOAD))
    assert store.ingest_batch(spark.createDataFrame(rows[:3], UPLOAD))[0] == 2


def test_zip_upload(spark, store):
    assert store.ingest_zip(zipped(docs__a="保密协议 不得披露", b="plain words here"))[0] == 2
    for bad in (zipped(**{"..__a": "x"}), zipped(**{"in.zip": "x"})):
        with pytest.raises(ValueError):
            store.ingest_zip(bad)


def test_tree(spark, tmp_path):
    for n in (".env", "a/b/c.txt", ".git/no", "a/node_modules/no", "a/large"):
        (tmp_path / "t" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / n).write_bytes(b"x" * (2000 if n == "a/large" else 5))
    found = {r.path.removeprefix(f"{tmp_path}/t/"): r.length for r in read_tree(spark, f"{tmp_path}/t", 1000).collect()}
    assert found == {".env": 5, "a/b/c.txt": 5}
    assert read_tree(spark, f"{tmp_path}/t/a/large", 1000).count() == 1  # a lone file has no limit
    assert read_tree(spark, f"{tmp_path}/t/.git").count() == 0


def test_command_line(spark, store, tmp_path, capsys):
    t = tmp_path / "files"
    (t / "nested").mkdir(parents=True)
    (t / "customer_copy.txt").write_bytes(SAMPLE.encode())
    (t / "normal.txt").write_text("nothing to see")
    (t / "slides.pptx").write_bytes(b"x")
    (t / "nested" / "archive.zip").write_bytes(zipped(**{"docs__customer.txt": SAMPLE + "more", "..__evil.txt": SAMPLE}))
    db = ["--db", f"{tmp_path}/local"]
    came = cli.main([*db, "sync", "--server", store.root], spark)
    assert came["version"] == 1 and came["updated"] and came["rules_count"] > len(BUILTIN_RULES) - 1 and came["deleted_rules_count"] == 0 and came["fingerprints_count"] == 2
    again = cli.main([*db, "sync", "--server", store.root], spark)
    assert again["version"] == 1 and not again["fingerprints_count"]
    counts = cli.main([*db, "scan", "--path", str(t), "--server", store.root, "--report", "--host-id", "h1", "--json"], spark)
    assert counts["total"] == 4 and counts["sensitive"] == 2
    local = Store(spark, f"{tmp_path}/local")
    by = {r.file_path.removeprefix(f"{t}/"): r for r in local.list_tags().collect()}
    assert by["customer_copy.txt"].match_score == 100 and by["customer_copy.txt"].sensitive_type == "样本指纹命中"
    assert by["normal.txt"].confidence_level == "clean" and by["nested/archive.zip!docs/customer.txt"].match_score >= 80
    assert json.loads(by["slides.pptx"].match_detail)["skip_reason"] == "unsupported_format"
    assert local.list_tags(True).count() == 2 and store.list_results("h1", "low_confidence").count() == 2 and store.list_results("h2").isEmpty()
    first = by["normal.txt"].first_detected_at
    cli.main([*db, "scan", "--path", str(t), "--no-sync"], spark)
    again = {r.file_path: r for r in local.list_tags().collect()}
    assert len(again) == 4 and again[f"{t}/normal.txt"].first_detected_at == first
    cli.main([*db, "list", "--json"], spark)
    assert "customer_copy.txt" in capsys.readouterr().out
    cli.main([*db, "clear"], spark)
    assert local.list_tags().isEmpty()


def test_report_limits(spark, store):
    with pytest.raises(ValueError):
        store.report(store.table("results"), " ", "/", "now")


def test_generated_keywords(spark):
    text = "这份文件包含客户报价资料，客户名称和联系人需要保密"
    got = [r.word for r in generate.keywords(spark.createDataFrame([(1, text, "", "")], "id long, text string, sensitive_type string, description string"), "id").orderBy("place").collect()]
    assert {"客户名称", "联系人", "报价"} <= set(got) and not {"文件", "资料"} & set(got)


@pytest.mark.parametrize("kind, want", [("财务预算", "财务预算组合识别"), ("薪资", "薪资绩效组合识别"), ("源代码", "源码泄露组合识别"), ("合同", "合同保密组合识别")])
def test_templates(spark, kind, want):
    df = spark.createDataFrame([(1, "text", kind, None, None)], "id long, text string, sensitive_type string, risk_level string, description string")
    assert want in {r.rule_name for r in generate.rules(df, "id").where("rule_type = 'combined'").collect()}


def test_analysis_and_replies(spark):
    a = one(spark, generate.analyse(F.lit("内部培训资料包含未公开课件"), F.lit(""), F.lit("")))
    assert a.semantic_labels == ["内部培训资料", "未公开财报", "战略规划"] and a.risk_level == "medium" and a.sensitive_type == "内部培训资料/未公开财报/战略规划"
    assert one(spark, generate.analyse(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))).semantic_labels == [UNCLASSIFIED]
    reply = '```json\n{"semantic_labels": ["x"], "sensitive_type": "", "risk_level": "low", "explanation": "e"}\n```'
    got = one(spark, generate.parse_reply(F.lit(reply), F.lit("k"), F.lit("high")))
    assert (got.semantic_labels, got.sensitive_type, got.risk_level, got.explanation) == (["x"], "k", "low", "e")
    assert one(spark, generate.parse_reply(F.lit("no json"), F.lit("k"), F.lit("high"))) is None
    p = one(spark, generate.prompt(F.lit("{{RISK_LEVEL}}" + "z" * 5000), F.lit("k"), F.lit("low")))
    assert "敏感类型: k, 风险等级: low" in p and p.count("z") == 4000 - len("{{RISK_LEVEL}}")
    assert [one(spark, generate.higher_risk(F.lit(a), F.lit(b))) for a, b in (("low", "high"), ("critical", "high"), ("odd", "low"))] == ["high", "critical", "low"]


def test_sample_texts(spark):
    doc = zipped(**{"word__document.xml": "<w:d xmlns:w='w'><w:p><w:t>Hello</w:t></w:p><w:tbl><w:tc><w:p><w:t>cell</w:t></w:p></w:tc></w:tbl><w:p><w:t>end</w:t></w:p></w:d>"})
    rows = [("a.txt", b"a\xff \n\x00 b"), ("b.docx", doc), ("c.pdf", b"%PDF \x01 visible words \x02 ab"), ("d.docx", b"no"), (None, None)]
    got = {r.file_name: (r.text, r.extract_warning) for r in extract.sample_texts(spark.createDataFrame(rows, "file_name string, content binary")).collect()}
    assert got["a.txt"] == ("a b", None) and got["b.docx"] == ("Hello cell end", None) and got["c.pdf"] == ("%PDF visible words ab", "pdf_fallback")
    assert got["d.docx"][1].startswith("extract_error") and got[None] == ("", None)
    assert extract.docx(doc) == "Hello\nend\ncell"
    read = extract.sample_texts(spark.createDataFrame(rows[2:3], "file_name string, content binary"), lambda n, b: "read by a service").first()
    assert (read.text, read.extract_warning) == ("read by a service", None)


def test_ocr_replies():
    assert extract.ocr_text({"text": "a"}) == "a" and extract.ocr_text({"result": [{"lines": [{"text": "b"}, "c"]}]}) == "b\nc"
    assert extract.ocr_text({"result": {}, "data": {"recognized_text": "d"}}) == "d"
    with pytest.raises(ValueError):
        extract.ocr_text({"other": 1})


@pytest.mark.parametrize("name, size, want", [("a.txt", 1, None), ("", 1, "bad_name"), ("x" * 256, 1, "bad_name"), ("/a", 1, "bad_name"), ("a/../../b", 1, "bad_name"), ("a/../b", 1, None), (".", 1, "bad_name"), ("a", 0, "empty"), ("a", 51 << 20, "too_large"), ("..\\a", 1, "bad_name")])
def test_upload_errors(spark, name, size, want):
    assert one(spark, extract.upload_error(F.lit(name), F.lit(size))) == want


def test_scan_of_odd_rows(spark):
    prints = spark.createDataFrame([("f1", "x", "0" * 16)], "sensitive_file_id string, sha256 string, simhash string")
    rules = [{"rule_id": "r", "rule_type": "regex", "sensitive_type": "t", "risk_level": "low", "content": {"name": "bad", "pattern": "(a"}}, {"rule_id": "k", "rule_type": "keyword", "sensitive_type": "t", "risk_level": "low", "content": {"keywords": []}}]
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "!?"), ("c", "!?"), ("d", "word " * 50_000)], "path string, text string")
    got = {r.path: (r.match_score, r.sensitive_file_id) for r in scanning.scan_texts(df, scanning.Library(rules, prints)).collect()}
    assert got == {"a": (0, None), "b": (0, None), "c": (70, "f1"), "d": (0, None)}  # texts without tokens have equal fingerprints
    assert scanning.scan_texts(df.where("false"), scanning.Library([], prints)).isEmpty()


def test_a_scan_survives_bad_files(spark, tmp_path):
    good = zipped(**{"in.txt": "13800138000 fine"})
    corrupt = bytearray(zipped(**{"a.txt": "first " * 50, "b.txt": "second 13800138000"}))
    corrupt[40:60] = b"\xff" * 20
    sealed = bytearray(zipped(**{"s.txt": "sealed"}))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        sealed[sealed.index(mark) + at] |= 1
    doc = zipped(**{"word__document.xml": "<w:d xmlns:w='w'><w:p><w:t>Hello</w:t></w:p></w:d>"})
    rows = [("good.zip", good), ("corrupt.zip", bytes(corrupt)), ("sealed.zip", bytes(sealed)), ("cut.zip", good[:40]), ("bad.docx", b"PK\x03\x04" + b"x" * 50), ("sealed.docx", bytes(sealed)), ("sheet.xlsx", doc), ("p.pdf", b"%PDF-1.4 stream"), ("ok.txt", b"13800138000 here")]
    prints = spark.createDataFrame([("f1", "x", "0" * 16)], "sensitive_file_id string, sha256 string, simhash string")
    rules = [{"rule_id": "r", "rule_type": "regex", "sensitive_type": "t", "risk_level": "high", "content": {"name": "mobile_phone", "pattern": r"\b1[3-9]\d{9}\b"}}]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.match_score, json.loads(r.match_detail)) for r in scanning.scan_files(files, scanning.Library(rules, prints), pdf=lambda name, data: "").collect()}
    assert got["good.zip!in.txt"][0] == 30 and got["ok.txt"][0] == 30
    assert got["corrupt.zip!b.txt"][0] == 30 and "extract_error" in got["corrupt.zip!a.txt"][1]
    for name in ("sealed.zip!s.txt", "cut.zip", "bad.docx", "sealed.docx"):
        assert got[name][0] == 0 and got[name][1]["extract_error"], name
    assert got["p.pdf"][0] == 0 and got["p.pdf"][1]["skip_reason"] == "pdf_text_empty"
    (hit,) = got["good.zip!in.txt"][1]["regex_hits"]
    assert hit["pattern"] == rules[0]["content"]["pattern"] and hit["match_count"] == 1 and hit["matches"] == ["1***0"]
    no_reader = scanning.scan_files(files.where("path = 'p.pdf'"), scanning.Library(rules, prints), pdf=None).first()
    assert json.loads(no_reader.match_detail)["skip_reason"] == "pdf_reader_missing"


def test_a_large_library_of_few_patterns(spark):
    """Twenty thousand rules over the builtin patterns and some words are one plan of bounded size, and give what each rule gives."""
    rules = [{"rule_id": f"r{i}", "rule_type": "regex", "sensitive_type": n, "risk_level": r, "content": {"name": n, "pattern": p}} for i in range(1000) for n, p, r in BUILTIN_RULES]
    rules += [{"rule_id": f"k{i}", "rule_type": "keyword", "sensitive_type": "w", "risk_level": "low", "content": {"keywords": ["alpha", f"w{i % 50}"], "min_hits": 2}} for i in range(1000)]
    prints = spark.createDataFrame([("f1", "x", "0" * 16)], "sensitive_file_id string, sha256 string, simhash string")
    df = spark.createDataFrame([("a", "call 13800138000 or b@c.de"), ("b", "alpha w7 w8"), ("c", "alpha")], "path string, text string")
    got = {r.path: json.loads(r.match_detail) for r in scanning.scan_texts(df, scanning.Library(rules, prints)).collect()}
    assert len(got["a"]["regex_hits"]) == 3000 and {h["rule_name"] for h in got["a"]["regex_hits"]} == {"mobile_phone", "email", "domain"}
    assert [h["rule_id"] for h in got["b"]["keyword_hits"]] == [f"k{i}" for i in range(1000) if i % 50 in (7, 8)] and got["b"]["keyword_hits"][0]["keywords_matched"] == ["alpha", "w7"]
    assert got["c"]["keyword_hits"] == []


def test_label_details_of_a_known_sample(spark):
    import hashlib

    prints = spark.createDataFrame([("f1", hashlib.sha256(b"same").hexdigest(), "0" * 16)], "sensitive_file_id string, sha256 string, simhash string")
    labels = spark.createDataFrame([("f1", ["L"], "emb_1")], "sensitive_file_id string, semantic_labels array<string>, embedding_id string")
    detail = json.loads(scanning.scan_texts(spark.createDataFrame([("a", "same")], "path string, text string"), scanning.Library([], prints, labels)).first().match_detail)
    assert detail["semantic_labels"] == ["L"] and detail["embedding_id"] == "emb_1" and detail["sha256_hit"]
