"""Vocabularies of the codec: names and strings with short ids.

A vocabulary is data. The default has the element and attribute names of the HTML
standard in alphabetical order and a few everyday strings; ``learn`` derives the
strings from a corpus; archives written elsewhere need the vocabulary they were
written with, as a table ``kind, id, token``.
"""

from __future__ import annotations

from typing import NamedTuple

UNKNOWN = 0xFE

_TAGS = """
a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center circle cite
clippath code col colgroup data datalist dd defs del details dfn dialog div dl dt ellipse em embed fieldset figcaption
figure font footer form g h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li line
lineargradient link main map mark math menu meta meter nav noscript object ol optgroup option output p param path pattern
picture polygon polyline pre progress q radialgradient rect rp rt ruby s samp script search section select slot small
source span stop strong style sub summary sup svg symbol table tbody td template text textarea tfoot th thead time title
tr track tspan u ul use var video wbr
"""
_ATTRS = """
abbr accept action align allow alt aria-controls aria-describedby aria-expanded aria-hidden aria-label aria-labelledby
async autocomplete autofocus autoplay bgcolor border cellpadding cellspacing charset checked cite class color cols colspan
content contenteditable controls coords crossorigin cx cy d data-action data-href data-id data-index data-name data-src
data-target data-toggle data-type data-url data-value datetime defer dir disabled download draggable enctype fill for form
frameborder headers height hidden href hreflang http-equiv id integrity itemid itemprop itemscope itemtype lang list
loading loop max maxlength media method min minlength multiple muted name nonce novalidate onclick onload open pattern
placeholder points poster preload property r readonly rel required reversed role rows rowspan rx ry sandbox scope selected
shape size sizes span spellcheck src srcdoc srclang srcset start step stroke stroke-width style summary tabindex target
title transform translate type usemap valign value version viewbox width wrap x x1 x2 xlink:href xmlns y y1 y2
"""
_STRINGS = """
# / 0 1 2 10 100 100% 16 20 24 32 48 64 _blank active alternate anonymous article auto author btn button canonical card
center checkbox clearfix col column container content dark de description disabled en es external false fixed flex footer
form fr get grid header hidden home icon image image/png image/svg+xml img inline item left light link list logo main menu
nav nav-item navigation next nofollow none noopener noreferrer og:image og:title og:url page post prev primary right
robots row search section sidebar small span stylesheet submit tab table text text/css text/html text/javascript title
top true url utf-8 viewport website wrapper
"""
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))


class Vocabulary(NamedTuple):
    tags: tuple[str, ...]
    attrs: tuple[str, ...]
    strings: tuple[str, ...]

    @staticmethod
    def of(tags, attrs, strings) -> Vocabulary:
        if len(tags) > UNKNOWN or len(attrs) > UNKNOWN or len(strings) > 1 << 16:
            raise ValueError("a vocabulary has at most 254 tags, 254 attributes and 65536 strings")
        for names in (tags, attrs, strings):
            if len(set(names)) < len(names):
                raise ValueError("the names of a vocabulary must differ")
        return Vocabulary(tuple(tags), tuple(attrs), tuple(strings))

    def rows(self) -> list[tuple[str, int, str]]:
        return [(kind, i, t) for kind, names in zip(("tag", "attr", "string"), self) for i, t in enumerate(names)]


DEFAULT = Vocabulary.of(_TAGS.split(), _ATTRS.split(), _STRINGS.split())
VOCABULARY_DDL = "kind string, id int, token string"


def vocabulary_table(spark, vocabulary: Vocabulary = DEFAULT):
    """The vocabulary as a DataFrame ``kind, id, token``; a few thousand rows at most."""
    return spark.createDataFrame(vocabulary.rows(), VOCABULARY_DDL)


def from_table(df) -> Vocabulary:
    """A vocabulary from rows ``kind, id, token``; ids must be 0, 1, 2, ... within a kind."""
    by: dict[str, dict[int, str]] = {"tag": {}, "attr": {}, "string": {}}
    for r in df.select("kind", "id", "token").toLocalIterator():
        by[r.kind][r.id] = r.token
    for kind, names in by.items():
        if sorted(names) != list(range(len(names))):
            raise ValueError(f"ids of kind {kind} must count up from 0")
    return Vocabulary.of(*([names[i] for i in range(len(names))] for names in by.values()))


def learn(nodes, size: int = 1024, base: Vocabulary = DEFAULT) -> Vocabulary:
    """``base`` with the ``size`` attribute values and class tokens of ``nodes`` that save the most bytes."""
    from pyspark.sql import functions as F

    value = F.explode(F.flatten(F.transform("attrs", lambda a: F.when(a["name"] == "class", F.split(a["value"], r"\s+")).otherwise(F.array(a["value"])))))
    tokens = nodes.where(F.size("attrs") > 0).select(value.alias("token")).where("token <> '' and octet_length(token) <= 64")
    best = tokens.groupBy("token").count().orderBy((F.col("count") * F.octet_length("token")).desc(), "token").limit(size)
    return Vocabulary.of(base.tags, base.attrs, [r.token for r in best.collect()])
