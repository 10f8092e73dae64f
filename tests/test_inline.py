"""Tags in lines, macros that are names, declared rows, names of players, hints of folders."""

from pyspark.sql import functions as F

from glyphmill.operators import inline
from glyphmill.sources import identify


def said(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["kind"], r["text"]) for r in inline.messages(df).orderBy("seq").collect()]


def test_messages_between_pauses(spark):
    text = "// a remark\n\n＠name\n<color=1>＠other</color>\n <a if=\"1 > 0\">one </a>\r\n<b>two</b> // why<pb>\n<pb>\n<case value=\" yes \"><CASE if=\"a>b\" value=\"no\"><case x=\"1\">\n<set v=\"//\">three<pb wait=\"1\">four\nopen <tag never closed\nfive"
    assert said(spark, text) == [("message", "onetwo"), ("choice", "yes"), ("choice", "no"), ("message", "threefour"), ("message", "openfive")]
    assert said(spark, "") == said(spark, None) == said(spark, "<pb>\n<pb>") == []
    long = "<x a=\"" + ">" * 50_000 + "\">text" + "<b c=\"d\">" * 20_000
    assert said(spark, long) == [("message", "text")]


def test_name_macros(spark):
    rows = {
        "ch": '[hr][ch text="名前"][r]\r\n[playse a]', "ch more": '[ch text="名前"]と', "eval": "[eval exp=%name|f.name='名'] [nowait]【[emb exp=f.name]】[endnowait]", "【語】": "[nowait]\n　語り[r] \n[endnowait]",
        "【空】": "[nowait]　　[endnowait]", "plain": "\r\n【相沢　舜】[r]\r\n", "wide": "　名[l]", "code": "@eval exp=名", "ascii": "[r]name[p]", "tags": "[wait]名", "empty": "", "blank": "　",
    }
    df = spark.createDataFrame([*rows.items(), ("null", None)], "name string, body string")
    got = {r["name"]: r["shown"] for r in inline.name_macros(df).collect()}
    assert got == {"ch": "名前", "eval": "【名】", "【語】": "語り", "plain": "【相沢　舜】", "wide": "　名"}


def test_declared_rows(spark):
    texts = ["全 37,310 行\n成品 **12,345 行**\n成品 99,999 行", "计 1234 行\n粗 **5678行**", "1234 行 5678 行", "12345678 行\n999 行", "txt 4321 行\n**9999 行**", "", None, "x ** 12,345 行 and 77,777 行"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["rows"] for r in inline.declared_rows(df).collect()} == {0: 12345, 1: 5678, 2: 1234, 4: 4321, 7: 12345}


def test_names_and_folders(spark):
    df = spark.createDataFrame([("#NAME[1]さん\n#NAME[2]", "a/b/eboot.bin"), ("", "a/sce_pfs/c/eboot.bin"), (None, "eboot.bin"), ("x", "a/b/eboot.bin.txt"), ("x", None), ("x", "a/b/eboot.bin")], "t string, path string")
    assert [r[0] for r in df.select(inline.with_full_name(F.col("t"), "立花", "香")).collect()][:3] == ["立花さん香", "", None]
    got = sorted(tuple(r) for r in identify.directory_hints(df, identify.FOLDER_HINTS).collect())
    assert got == [("", "eboot.bin", "application"), ("a", "sce_pfs", "protected files"), ("a/b", "eboot.bin", "application"), ("a/sce_pfs/c", "eboot.bin", "application")]
