import gzip
import json
import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import codec, vocabulary
from leafmill.functions import html as H
from leafmill.functions import text as T

C = codec.Codec()

#: Pages and what decoding gives.
GOLDEN = {
    "<html><head><title>Hi</title></head><body><p>all</p></body></html>": "<html>\n  <head>\n    <title>\nHi\n    </title>\n  </head>\n  <body>\n    <p>\nall\n    </p>\n  </body>\n</html>",
    '<a class="btn  x y" href="/?a=1&amp;b=2" title="&lt;q&quot;">l</a>': '<a class="btn x y" href="/?a=1&amp;b=2" title="&lt;q&quot;">\nl\n</a>',
    "<!DOCTYPE html><!-- c --><br><input required>": "<!DOCTYPE html>\n<!-- c -->\n<br>\n<input required>",
    '<style>p > q { k: "v" }</style><script>if (i < n && m) g("&")</script>': '<style>\np > q { k: "v" }\n</style>\n<script>\nif (i < n && m) g("&")\n</script>',
    "<x-tag data-zz=1>5 &lt; 6</x-tag></p>": '<x-tag data-zz="1">\n5 &lt; 6\n</x-tag>\n</>',
    "<svg viewBox='0 0 1 1'></svg>": '<svg viewbox="0 0 1 1">\n</svg>',
    "": "",
}


@pytest.mark.parametrize("page,expected", GOLDEN.items())
def test_golden(page, expected):
    assert C.decode(C.encode(page), strict=True) == expected


@pytest.mark.parametrize("n", [0, 1, 253, 254, 255, 256, 70_000])
def test_lengths_of_strings(n):
    page = f"<p>{'ä' * (n // 2) + 'x' * (n % 2)}</p>"
    assert list(C.nodes(C.encode(page), True))[1:-1] == ([(codec.TEXT, None, [], page[3:-4])] if n else [])


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256])
def test_class_lists(n):
    value = "  ".join(f"t{i}" for i in range(n))
    attrs = next(iter(C.nodes(C.encode(f'<p class="{value}">'), True)))[2]
    assert attrs == [("class", value if n == 256 or n == 0 else " ".join(value.split()))]


def test_more_than_255_attributes(spark):
    page = "<p " + " ".join(f"a{i}" for i in range(256)) + ">"
    with pytest.raises(ValueError):
        C.encode(page)
    assert spark.createDataFrame([(page,)], "html string").select(H.encode_html("html")).first()[0] is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/ab =\"'&;!-\n\té🙂"), max_size=80))
def test_any_page_comes_back_as_nodes(page):
    nodes = codec.parse(page)
    again = list(C.nodes(C.encode_nodes(nodes), True))
    assert [n[0] for n in again] == [n[0] for n in nodes]
    assert [n[3] for n in again if n[3]] == [n[3] for n in nodes if n[3]]


def test_broken_blobs():
    good = C.encode("<p a=b>text</p>")
    for bad in (b"", b"\0\0", good[:-2], b"\0\0\0\1\x09", b"\0\0\0\2\1"):
        with pytest.raises(codec.CorruptDocument):
            C.decode(bad, strict=True)
    assert C.decode(b"\0\0\0\1\x09") == ""


def test_bytes_outside_utf8_and_surrogates():
    assert codec.to_text(b"a\xffb") == "a�b" and "\ud800" not in codec.to_text("a\ud800b")
    C.encode("<p>\ud800</p>")


def test_other_vocabulary(spark):
    v = vocabulary.Vocabulary.of(("p",), ("class",), tuple(f"s{i}" for i in range(400)))
    c = codec.Codec(vocabulary.from_table(vocabulary.vocabulary_table(spark, v)))
    page = '<p class="s0 s251 s252 s399 other" id="s300">x</p>'
    assert c.decode(c.encode(page), True) == '<p class="s0 s251 s252 s399 other" id="s300">\nx\n</p>'
    with pytest.raises(ValueError):
        vocabulary.Vocabulary.of(("p", "p"), (), ())


def test_text_of_boilerplate():
    page = '<div>a<nav role="Navigation"><p>no</p></nav>b<div class="x NAVBOX-1">no</div><table><tr><td>1<td>2</table></div>'
    assert codec.nodes_text(codec.parse(page)) == "ab\n\n 1 2"
    leak = '<div class="navbox"><p>no</div>rest'
    assert codec.nodes_text(codec.parse(leak)) == "" and codec.nodes_text(codec.parse(leak), repair=True) == "rest"


def test_native_text_encoding_is_the_codec_s(spark):
    texts = ["", "a", "é" * 127, "x" * 254, "x" * 255, "🙂" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.encode_text("t").alias("e"), T.text_size("t").alias("n"))
    for r in df.collect():
        assert bytes(r.e) == C.encode_text(r.t) and r.n == len(r.e)


def test_native_tidy_is_the_codec_s(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab \t\n\r\f\v é") for _ in range(20)) for _ in range(200)]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tidy("t").alias("x")).collect():
        assert row.x == codec.tidy(row.t)


def test_scalars(spark):
    row = spark.createDataFrame([(" A b/;. ", "Key : v:w ", '<&">')], "a string, h string, e string").select(T.norm_title("a").alias("a"), T.header_pair("h").alias("h"), T.escape_text("e").alias("e"), T.escape_attr("e").alias("f"), T.id_size(F.lit(252)).alias("i"), T.human_size(F.lit(2048)).alias("s")).first()
    assert (row.a, tuple(row.h), row.e, row.f, row.i, row.s) == ("a b", ("key", "v:w"), '&lt;&amp;"&gt;', "&lt;&amp;&quot;>", 3, "2.0 KB")


def test_nodes_and_sql_functions(spark):
    H.register(spark)
    pages = spark.createDataFrame([(1, "<p id=x>hi<br></p>"), (2, None)], "page_id long, html string")
    rows = [(r.page_id, r.seq, r.op, r.tag, r.payload) for r in H.html_nodes(pages, "page_id").orderBy("seq").collect()]
    assert rows == [(1, 0, 1, "p", None), (1, 1, 3, None, "hi"), (1, 2, 6, "br", None), (1, 3, 2, "p", None)]
    pages.createOrReplaceTempView("some_pages")
    got = spark.sql("select page_id, extract_text(html) t, decode_html(encode_html(html)) d from some_pages order by 1").collect()
    assert (got[0].t, got[1].t, got[0].d) == ("hi", None, '<p id="x">\nhi\n  <br>\n</p>')
    assert spark.sql("select count(*) from some_pages, lateral html_nodes(html)").first()[0] == 4


def test_compression(spark):
    df = spark.createDataFrame([(b"abc" * 100,), (None,)], "b binary")
    row = df.select(H.zstd_decompress(H.zstd_compress(F.col("b"))).alias("z"), H.zlib_decompress(H.zlib_compress(F.col("b"))).alias("d"), H.gzip_member(F.col("b")).alias("g")).first()
    assert bytes(row.z) == bytes(row.d) == gzip.decompress(bytes(row.g)) == b"abc" * 100


def test_cascade(spark):
    def picky(v):
        if "bad" in v:
            raise RuntimeError
        return None if "none" in v else "picked"

    df = spark.createDataFrame([("<p>fine</p>",), ("<p>bad</p>",), ("<p>none</p>",)], "html string")
    assert [r[0] for r in df.select(H.extract_cascade(F.col("html"), picky)).collect()] == ["picked", "bad", "none"]


def test_learned_vocabulary(spark):
    pages = spark.createDataFrame([('<p class="often rare1">' * 5 + '<a href="/same/long/path">' * 3,)], "html string")
    v = vocabulary.learn(H.html_nodes(pages, "html").select("attrs"), 2)
    assert v.strings == ("/same/long/path", "often") or set(v.strings) <= {"/same/long/path", "often", "rare1"}
    json.dumps(v.rows())


@pytest.mark.parametrize("html,text", [("<p>AT&T", "AT&T"), ("<p>x&amp", "x&"), ("<p>a<b", "a"), ("", "")])
def test_closing_keeps_text_at_the_end(html, text):
    assert codec.nodes_text(codec.parser("closed")(html)).startswith(text)
    assert codec.parser("plain")(html) == codec.parse(html)


def test_repaired_trees():
    pytest.importorskip("lxml")
    nodes = codec.parser("repaired")("<!DOCTYPE html><p>one<p>two<br>three<!-- c --><script>1 < 2</script>")
    assert [n[1] for n in nodes if n[0] == codec.OPEN] == ["html", "body", "p", "p", "script"] and nodes[0] == (codec.DOCTYPE, None, [], "DOCTYPE html")
    assert sum(n[0] == codec.CLOSE for n in nodes) == 5 and codec.nodes_text(nodes) == "one\ntwo\nthree"


def test_strict_text():
    c = codec.Codec()
    blob = c.encode("<p>hello</p>")
    with pytest.raises(codec.CorruptDocument):
        c.text(blob[:4] + bytes([99]) + blob[5:], strict=True)


def test_a_batch_is_not_held_as_objects(spark):
    """A batch of 20 MB goes through a function on columns with few of its values as Python objects at a time."""
    col = pa.array([str(i % 10) * 10_000 for i in range(2000)])
    tracemalloc.start()
    try:
        out = H._mapped(str.upper, "string").func(col)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pa.array(out).equals(col) and most < 10e6


def test_recoding_encodes_once(spark):
    wide = "<p " + " ".join(f"a{i}" for i in range(300)) + ">"  # can't be encoded
    pages = spark.createDataFrame([(i, h) for i, h in enumerate([*GOLDEN, wide, None])], "page_id long, html string")
    e = pages.select("page_id", H.encode_html("html").alias("e")).select("page_id", F.octet_length("e").alias("n"), H.decode_html("e").alias("back"))
    r = pages.select("page_id", H.recode_html("html").alias("r")).select("page_id", "r.encoded_bytes", "r.decoded")
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, e.collect()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_encoded_html_has_one_python_function(spark):
    from leafmill.plans import registry

    plan = registry.encoded_html(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan and "run(run(" not in plan
