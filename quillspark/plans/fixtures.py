"""Small inline tables for queries whose text the test tables lack (CJK letters, reports, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "zh_lines": ("doc_id bigint, line_no int, line string", [
        (1, 0, "第 1 頁 / 共 2 頁"), (1, 1, "臺北地方法院"), (1, 2, "....."), (1, 3, "裝"), (1, 4, "訂"), (1, 5, "線"), (1, 6, "主旨：查詢保單"), (1, 7, ""), (1, 8, ""), (1, 9, "說明如下"),
        (2, 0, "第1頁,共10頁"), (2, 1, "- 3 -"), (2, 2, "____"), (2, 3, "Page 2/3"), (2, 4, "本件係"), (2, 5, "通知函"), (2, 6, "…"), (2, 7, "abc"), (2, 8, "abc"), (2, 9, "。"),
        (3, 0, "甲"), (3, 1, "乙"), (3, 2, "丙"), (3, 3, "丁"), (3, 4, "戊"), (3, 5, "己"), (3, 6, "結論"), (3, 7, "a"), (3, 8, "bc"), (3, 9, "第 3 頁 共 5 頁"),
    ]),
    "zh_letters": ("doc_id bigint, label string, text string", [
        (1, "扣押命令", "發文機關：臺北地方法院\n發文字號：北院司執字第123號\n主旨：請扣押債務人存款。\n說明：一、依強制執行法第115條辦理。\n二、請於7日內函覆。\n要保人：王小明 A123456789\n附件：清冊"),
        (2, "通知函", "受文者：某公司\n主旨：請查照。\n依據：保險法第 12 條；其他\n電話：02-1234\n傳真：02-9999\n承辦人：李四\n地址：台北市中正區一段"),
        (3, "保單查詢", "主旨：查詢保單號：AB12345678 資料\n理由：2025/09/05 前回覆\n被保險人：\n張○○ 先生\n附件：無"),
        (4, "撤銷令", "一、撤銷前令。\n二、114年9月5日前辦理"),
        (5, "收取令", "無任何欄位的文字內容共二十個字以上才有中段"),
        (6, "收取令", "主旨:\n說明:於二十五日內收取\n主旨:補充"),
        (7, "收取令", ""),
    ]),
    "cases": ("doc_id bigint, text string", [(1, "調查人一\n姓名：王小明\n身分證字號：A123456789\n財產基準日：114年1月1日\n調查人二\n姓名：李四\n＝＝＝\n調查人一\n姓名：陳五\n財產基準日：無"), (2, "＝＝＝＝")]),
    "zh_transcript": ("conv_id bigint, text string", [
        (1, "L: 請問您是王小明先生嗎\nR: 是 我的手機是0912\nR: 345678\nL: 好的\nR: 信箱是 abc@gmail.com\n(雜音)"),
        (2, "R: 我是陳大文\nR: 身分證A1234\nL: 嗯\nR: 56789\nR: 生日民國87年10月21日"),
        (3, "L: 12\nR: 0912\nR: 345\nL: 好\nR: 1234567"),
    ]),
    "profiles": ("profile_no int, name string, birth_date string, id_number string, address string, mobile string, email string", [
        (1, "林一", "1998-10-21", "b223456789", "新北市板橋區文化路1號", "+886912000111", "fake1@gmail.com"), (2, "黃二", "1985/01/02", "C123456780", "台中市西區民生路2號", "0922-000-222", "fake2@gmail.com"),
        (3, "吳三", "民國87年10月21日", "D223456781", "高雄市三民區建國路3號", "0933000333", "fake3@gmail.com"), (4, " ", "", "", "", "", ""), (5, "周四", "75/3/4", "E123456782", "台南市東區中華路4號", "0944000444", "fake5@gmail.com"),
    ]),
    "births": ("row_no int, original string, fake string", [
        (1, "民國80年1月2日", "1998-10-21"), (2, "80/1/2", "1998/10/21"), (3, "80-01-02", "1998.1.2"), (4, "80.1.2", "87/10/21"), (5, "1991/1/2", "民國87年10月21日"), (6, "1991-1-2", "1998-1-2"), (7, "1991.1.2", "1998-1-2"), (8, "1991年1月2日", "1998-1-2"), (9, "其他", "1998-1-2"),
    ]),
    "twids": ("id string", [("A123456789",), ("A123456788",), ("Z123456789",), ("a123456789",), ("F131104093",), ("B12345678",), ("",)]),
    "dates": ("row_no int, text string", [(1, "請於2025/09/05前"), (2, "114年9月5日"), (3, "中華民國 2025年9月6日"), (4, "2025/13/05 於7日內"), (5, "於二十五日內"), (6, "在十日內"), (7, "沒有"), (8, "99年1月1日"), (9, "於三日內 急件"), (10, "速別：普通件")]),
    "metrics_a": ("pos int, model string, acc string, time_str string", [(0, "qwen2.5:3b", "0.82", "2分15秒"), (1, "llama3:8b", "0.7", "45秒"), (2, "old-7b", "x", "3分"), (3, "qwen2.5:3b", "0.84", "2分10秒"), (4, " ", "0.1", "1秒")]),
    "metrics_b": ("pos int, model string, acc string, time_str string", [(0, "qwen2.5:3b", "0.8", "125.5秒"), (1, "old-7b", "0.5", ""), (2, "new", "0.9", "junk"), (3, "llama3:8b", "0.71", "0秒")]),
    "answers": ("key string, base_date string, agency string, receipt_no string, subject string", [("a.txt", "114年1月1日", "臺北地院", "123", "王小明"), (" b.txt ", "114年2月1日", "國稅局", "456", "李四"), ("c.txt", "x", "y", "z", "w")]),
    "preds": ("key string, base_date string, agency string, receipt_no string, subject string", [("a.txt", " 114年1月1日", "臺北地院", "123 ", "王大明"), ("b.txt", "114年2月1日", None, "456", "李四"), ("extra.txt", "", "", "", "")]),
    "call_json": ("id bigint, reply string", [
        (1, '【人類可讀摘要】\n摘要\n【JSON_OUTPUT】\n{"summary":["來電查詢"],"todo":{"status":"open","items":[{"description":"回電","need_follow_up":true,"need_callback":false,"note":"急"}]},"personal_info":{"is_policy_holder":true,"name":"王小明","address":{"old":"甲","new":null}},"complaint":{"has_complaint":false,"mentioned_authority":["金管會","評議中心"]},"narrative":"內容"}'),
        (2, '前言 {"summary":[],"narrative":" "} 後語'), (3, "沒有物件"), (4, '{"summary": [1,'), (5, '{"todo":{"items":[]},"complaint":{"has_complaint":true,"description":"久候"}}'),
    ]),
    "people_ids": ("row_no int, name string, id_number string, policy string", [(1, "王明", "A123456789", "AB12345678"), (2, "王小明", "a123", "12345678"), (3, "歐陽小明", "B223456789", "ABC"), (4, "王", "", "POLICY123456789012345"), (5, None, None, None)]),
    "ids": ("row_no int, case_no string, year_no string, box string", [(1, "北院司執", "114字第1號", "[[[10.4, 20.5], [3, 4]], [[0, 0], [7.6, 8.5]]]"), (2, "", "115字第2號", "[]"), (3, "中院", "", "[1, 2, 3, 4]")]),
    "briefs": ("row_no int, filename string, category string, insurer string, title string, summary string, name string, id_number string, policy string, action string, doc_no string", [
        (1, "b2", "扣押", "甲保", "標題<1>", "很長的摘要" * 30, "王小明", "A123456789", "AB12345678", "扣押", "字1"), (2, "b1", "扣押", None, "標題2", "短\n摘要", None, "x", "12", None, None), (3, "a", None, "乙保", None, None, "李四", "B223456789", "POLICY1234", "通知", "字3"),
    ]),
    "nudge_rows": ("row_no int, p1 double, p2 double, p3 double, text string", [(1, 0.5, 0.3, 0.2, "請扣押存款"), (2, 0.5, 0.45, 0.05, "撤銷前令"), (3, 0.34, 0.33, 0.33, "請查照轉知"), (4, 0.0, 1.0, 0.0, None)]),
    "rank_names": ("row_no int, name string", [(1, "doc2"), (2, "doc10"), (3, "doc1"), (4, None), (5, "a")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _value(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def sql(name: str) -> str:
    """The same table as a VALUES clause."""
    schema, rows = TABLES[name]
    columns = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
    cast = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in columns)
    return f"(SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in columns)}))"
