"""Column functions against hand-derived values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codewarden.functions import constants as K
from codewarden.functions import features as X
from codewarden.functions import prompts as P
from codewarden.functions import responses as R
from codewarden.functions import static_facts as S
from codewarden.functions import text as T
from codewarden.operators import normalize as N


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression).collect()]


def records(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", F.parse_json("t").alias("record"))


def test_name_lists():
    assert len(set(K.LEXICAL_API_NAMES)) == 173 and len(set(K.TOOL_SINK_NAMES)) == 174
    assert len(K.FEATURE_NAMES) == 15 and K.PROMPT_CODE_CHARS == 17054


@pytest.mark.parametrize("function, given, wanted", [
    (T.cwe_from_digits, ["398", " 398 ", "Null", "CWE-1", None, ""], ["CWE-398", "CWE-398", "None", "CWE-1", "None", "None"]),
    (T.cwe_upper, ["cwe-787", "none", "['CWE-1']", "", None, " non "], ["CWE-787", "N/A", "CWE-1", "N/A", "N/A", "N/A"]),
    (T.commit_id_from_link, ["https://h/o/r/commit/e34b/x", "https://h/abc", "", None], ["e34b", "abc", "unknown", "unknown"]),
    (T.stable_ratio, ["abc"], [0.5625200625509024]),
    (T.strip, ["\u00a0\t x y \u2003\n", "", "   "], ["x y", "", ""]),
    (T.words, ["  a\u00a0b\n\nc ", " "], [["a", "b", "c"], []]),
    (T.query_words, [" ", "a b"], [["void"], ["a", "b"]]),
    (T.drop_control_chars, ["a\x00b\x0bc\x0cd\x1fe\x7ff\tg\nh\ri"], ["abcdef\tg\nh\ri"]),
    (S.lexical_complexity, ["", None, "if (a && b) {}", "diff", "if" * 2000], [1, 1, 3, 2, 1000]),
])
def test_text_functions(spark, function, given, wanted):
    assert values(spark, given, "c string", function(F.col("c"))) == wanted


def test_content_md5_ignores_outer_white_space(spark):
    got = values(spark, ["\n x\u2003", "x"], "c string", T.content_md5(F.col("c")))
    assert got == [hashlib.md5(b"x").hexdigest()] * 2


def test_normalize_diversevul_labels_and_cwe(spark):
    out = N.normalize_diversevul(records(spark, [
        '{"func":"f","target":"1","cwe":["CWE-787"],"project":"qemu","commit_id":7,"size":18}',
        '{"func":"f","target":" True ","cwe":null}', '{"func":"f","target":"yes","cwe":[]}',
        '{"func":null,"target":true,"cwe":"CWE-20"}', '{"target":0}', '{"target":5}', '{"target":null}', '{"target":[1]}',
    ])).orderBy("i").collect()
    assert [r.target for r in out] == [1, 1, 0, 1, 0, 5, None, None]
    assert [r.cwe for r in out][:5] == ["CWE-787", "None", "[]", "CWE-20", "None"]
    assert out[0].commit_id == "7" and out[0].size == 18 and out[3].func == "" and out[0].dataset == "diversevul"


def test_normalize_vcl(spark):
    out = N.normalize_vcl(records(spark, ['{"func":"f","label":"1","cwe_id":"398","sink":"s"}', '{"func":"f","label":"no","cwe_id":null}'])).orderBy("i").collect()
    assert [(r.target, r.cwe, r.sink) for r in out] == [(1, "CWE-398", "s"), (0, "None", None)]


def test_unpivot_fixes(spark):
    out = N.unpivot_fixes(records(spark, [
        '{"func_src_before":"a","func_src_after":"","vul_type":"cwe-1","commit_link":"https://h/commit/z"}',
        '{"func_src_before":"a","func_src_after":"b","vul_type":["cwe-787"]}', '{"func_src_before":null,"vul_type":[]}'])).collect()
    assert sorted((r.i, r.func, r.target, r.cwe, r.commit_id, r.origin_source) for r in out) == [
        (0, "a", 1, "CWE-1", "z", "before"), (1, "a", 1, "CWE-787", "unknown", "before"), (1, "b", 0, "CWE-787", "unknown", "after")]


def test_normalize_devign_missing_and_null(spark):
    out = N.normalize_devign(records(spark, [
        '{"func":"f"}', '{"func":"f","target":null}', '{"func":"","target":1}', '{"func":"f","target":"1","commit_id":null}', '{"func":"f","target":"x"}'])).orderBy("i").collect()
    assert [(r.i, r.target, r.commit_id, r.project) for r in out] == [(0, 0, "unknown", "unknown"), (3, 1, None, "unknown")]


def test_kb_candidates_labels(spark):
    rows = records(spark, ['{"func":"f","target":1}', '{"code":"f","label":"0"}', '{"function":"f","vuln":2}', '{"func":"f","target":"1.0"}',
                           '{"func":"f"}', '{"func":"f","target":null,"label":" 1 "}', '{"func":"","target":1}'])
    out = N.kb_candidates(rows.withColumns({"file_name": F.lit("a.json"), "row_index": F.col("i")})).collect()
    assert [(r.label, r.skip) for r in out][:3] == [("VULNERABLE", False), ("BENIGN", False), ("BENIGN", False)]
    assert [r.skip for r in out][3:] == [True, True, False, True] and out[5].label == "VULNERABLE"
    assert out[0].original_id == "a.json_0_unk"


def test_names_used_whole_words_and_calls(spark):
    code = "x = fread(a); memcpy (b); my_strcpy(c); émalloc(d); /* free */ gets"
    assert values(spark, [code], "c string", S.names_used(F.col("c"))) == [["fread", "free", "gets", "memcpy"]]
    assert values(spark, [code], "c string", S.names_used(F.col("c"), calls_only=True)) == [["fread", "memcpy"]]


def test_scan_prefers_calls(spark):
    got = values(spark, ["memcpy(a); /* free */", "no call, but free is named", "nothing"], "c string", S.scan_names(F.col("c")))
    assert got == [["memcpy"], ["free"], []]


def test_sinks_match_substrings(spark):
    df = spark.createDataFrame([(["my_fread_all", "printf", "recvfrom", "recvfrom"],)], "c array<string>")
    assert df.select(S.sinks_called(F.col("c"))).first()[0] == ["my_fread_all", "recvfrom"]


def test_strip_comments_keeps_literals(spark):
    code = 'a = "/* no */"; // yes\nb = \'"\'; /* multi\nline */ c = "x // y"; d = 4 / 2; e = "\\"/*"; it\'s // end'
    want = 'a = "/* no */";  \nb = \'"\';   c = "x // y"; d = 4 / 2; e = "\\"/*"; it\'s  '
    assert values(spark, [code], "c string", S.strip_comments(F.col("c"))) == [want]


def test_strip_comments_is_linear(spark):
    long = ("word 'x' \"y\" / " * 40_000) + "/* tail */ z" + " q" * 100_000
    got = values(spark, [long], "c string", S.strip_comments(F.col("c")))[0]
    assert got == long.replace("/* tail */", " ")


def test_compress_cuts(spark):
    bare = "x" * 11_990
    soft, hard = "y" * 12_400, "z" * 20_000
    got = values(spark, [bare + "/* c */" * 50, soft, hard, "short // kept"], "c string", S.compress(F.col("c")))
    assert got[0] == (bare + " " * 50)[:6000] + K.SOFT_CUT_MARK + (bare + " " * 50)[-6000:] and got[3] == "short // kept"
    assert got[1] == "y" * 6000 + K.SOFT_CUT_MARK + "y" * 6000 and got[2] == "z" * 6000 + K.HARD_CUT_MARK + "z" * 6000


def test_nesting(spark):
    df = spark.createDataFrame([("f(a){ if (b[1]) { } } )",), ("",)], "c string").select(S.nesting(F.col("c")).alias("n"))
    rows = [r.n for r in df.collect()]
    assert (rows[0].depth, rows[0].tokens) == (3, 16) and rows[1].density == 0.0


def test_responses(spark):
    good = '{"thought_process":"t","final_decision":"VULNERABLE","confidence":85,"evidence":{"a":true,"b":"TRUE","c":1,"d":null,"e":1.5,"f":"no"}}'
    texts = [good, '{"thought_process":"t","confidence":1}', "junk", '{"thought_process":"t","final_decision":"BENIGN","confidence":"0.5","evidence":"x"}', None]
    out = R.parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")).orderBy("i").collect()
    r = [x.response for x in out]
    assert r[0].evidence == {"a": True, "b": True, "c": True, "f": False} and r[0].confidence == 0.85 and r[0].static_analysis_review == "AGREE"
    assert [x.valid for x in r] == [True, False, False, True, False]
    assert r[1].final_decision == "BENIGN" and r[1].confidence == 0.0 and r[1].cwe_id == "Unknown" and r[3].evidence == {}


def test_clamp_confidence(spark):
    assert values(spark, [85.0, 1.0, -0.2, 250.0], "c double", R.clamp_confidence(F.col("c"))) == [0.85, 1.0, 0.0, 1.0]


def test_certainty(spark):
    df = spark.createDataFrame([([(-0.1,), (None,), (-0.2,)],), ([],)], "lp array<struct<logprob:double>>")
    rows = df.select(R.native_confidence(F.col("lp")), R.entropy(F.col("lp"))).collect()
    assert rows[0][0] == pytest.approx(0.8617840855569707) and rows[0][1] == pytest.approx(0.2542298922191924)
    assert tuple(rows[1]) == (0.5, 0.0)


def test_reflection_and_conflict(spark):
    df = spark.createDataFrame([(2, False, 1, 0.9), (1, False, 1, 0.4), (1, False, 0, 0.1), (2, True, 0, 0.9)], "s int, f boolean, d int, c double")
    out = df.select(X.reflection_reason(F.col("s"), F.col("f"), F.col("d"), F.col("c")), X.weighted_conflict(F.col("s"), F.col("f"), F.col("d")),
                    X.flow_but_benign(F.col("f"), F.col("d"))).collect()
    assert [r[0] for r in out] == ["Conflict", "WeakCalibration", None, None]
    assert tuple(out[3])[1:] == (2.0, 1) and tuple(out[0])[1:] == (2.0, 0)


def test_finite(spark):
    nan, inf = float("nan"), float("inf")
    assert values(spark, [nan, inf, -inf, 0.5], "c double", X.finite(F.col("c"))) == [0.0, 1.0, -1.0, 0.5]
    assert values(spark, [nan, inf], "c double", X.finite(F.col("c"), infinite_to_one=False)) == [0.0, inf]


def test_hits_text_cap_and_empty(spark):
    hits = [(i, f"kb{i:04d}", 0.999, "BENIGN") for i in range(1, 200)]
    df = spark.createDataFrame([([(r, o, s, lab) for r, o, s, lab in hits],), ([],)], "h array<struct<rank:int,original_id:string,similarity:double,label:string>>")
    got = [r[0] for r in df.select(P.hits_text(F.col("h"))).collect()]
    assert len(got[0]) == 2000 and got[0].startswith("[Ref:kb0001 | Sim:99%] BENIGN\n") and got[1] == K.NO_HITS_TEXT


def test_prompts_are_sent_without_control_characters(spark):
    rows = spark.createDataFrame([("a\x00b\x1f\tc\r\nd\x7f",)], "p string")
    got = rows.select(P.as_sent(F.col("p")).alias("plain"), P.as_sent(F.col("p"), "be\x01 brief").alias("named")).first()
    assert got.plain == "ab\tc\r\nd" and got.named == "System: be brief\nUser: ab\tc\r\nd"
