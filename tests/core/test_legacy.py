import pytest

from leafmill.functions import codec
from leafmill.functions import html as H
from leafmill.sources import legacy

PAGES = ['<x-y class="one two one" id="some id">t é</x-y>', "", "<p>" + "x" * 300, '<a href="/long/path" data-q="/long/path">l</a>']


@pytest.mark.parametrize("page", PAGES)
def test_single_documents(page):
    c = codec.Codec()
    assert legacy.decode_single(legacy.encode_single(page)) == c.decode(c.encode(page))


def test_string_table_order():
    nodes = codec.parse('<q-a class="bb cc"><q-b id="cc"><q-b>')
    assert legacy.string_table(nodes) == ["cc", "q-b", "q-a", "bb"]


def test_broken_documents():
    good = legacy.encode_single(PAGES[0])
    for bad in (b"", b"LEA1", good[:9], good[:12] + b"zz" + good[14:]):
        with pytest.raises(codec.CorruptDocument):
            legacy.decode_single(bad)


def test_packs_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(f"{i}.html", p.encode()) for i, p in enumerate(PAGES)], "path string, content binary")
    legacy.write_pack(df, str(tmp_path / "p"))
    got = legacy.read_pack(spark, str(tmp_path / "p")).select("path", H.decode_html("encoded").alias("h")).orderBy("path").collect()
    c = codec.Codec()
    assert [(r.path, r.h) for r in got] == [(f"{i}.html", c.decode(c.encode(p))) for i, p in enumerate(PAGES)]
    one = df.select(legacy.decode_single_column(legacy.encode_single_column("content")).alias("h")).collect()
    assert sorted(r.h for r in one) == sorted(r.h for r in got)
