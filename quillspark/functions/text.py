"""Pure column expressions on text: normal forms, keys, tokens, dates, names and answer forms."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ligatures and their letters, and the dashes that read as a hyphen.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
DASHES = "‐‑‒–−"
# Words that never count in keyword retrieval.
STOPWORDS = """
a an the and or but if then than that this these those it its is are was were be been being
of in on at to for from by with without into over under about
we our you your they their he she his her
do does did can could should would may might will shall
not no nor so such very more most much many any all some each other another
what which who whom whose when where why how whether
there here also thus however therefore
one two three first second third
""".split()
# A question holds one of these, and begins with none of those.
QUESTION_MARKS = ("吗", "什么", "怎么", "如何", "哪些", "哪一", "哪个", "多少", "是否", "为什么", "区别", "作用", "流程", "有哪些", "几")
DANGLING = "年的了的和与及在对于关于这那其"
# Patterns of a conclusion's form.
BARE_PREFIX = r"^\*{0,2}\s*结论\s*[:：]\s*\*{0,2}\s*(?:不是|并非|未|没有|不需|不存在)"
BARE = r"(?:结论\s*[:：]\s*\*{0,2}\s*|^\*{0,2}\s*)(?:不是|并非|未|没有|不需|不存在)"
EXCLUSION = r"(?:不是|并非|并未|未|没有|不用|不使用)\s*\*{0,2}\s*(?:是|由|用|采用|使用|借助|通过|生成|涉及|包含)"
COVERAGE = r"(?:未|没有|无|没有任何)[^。；;，]{0,10}(?:提及|提到|说明|报道|记载|记录|检索到|找到|证据|覆盖|涉及)|(?:知识库|语料|材料|文献)[^。；，]{0,8}(?:没有|未|无)"
SCOPE = "知识库|语料|材料|文献|检索|文档中|已索引"
# The form of an identifier of submission.
ARXIV = r"(?<!\d)(\d{2})(0[1-9]|1[0-2])\.\d{4,5}(?:v\d+)?(?!\d)"
#: The same with a number of any length from four digits on, for stores whose own numbers have outgrown five.
LONG_ARXIV = ARXIV.replace("{4,5}", "{4,}")
# Names of a paper's states.
STATUS_NAMES = {0: "pending", 1: "indexed", 2: "failed", 3: "indexing"}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_typography(text: Column | str) -> Column:
    """ligatures become letters and short dashes a hyphen; the long dash stays."""
    out = _col(text)
    for mark, letters in (LIGATURES | dict.fromkeys(DASHES, "-")).items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


def norm_for_match(text: Column | str) -> Column:
    """F1, lower case, no commas or spaces between digits, single spaces."""
    out = F.regexp_replace(F.lower(normalize_typography(text)), r"(?U)(?<=\d)[,\s]+(?=\d)", "")
    # A space by itself stays, so it isn't replaced by another one.
    return F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]", " "))


def content_key(text: Column | str) -> Column:
    """F3."""
    return F.sha1(norm_for_match(text).cast("binary"))


def doc_key(source: Column | str, page_label: Column | str, content: Column | str) -> Column:
    """F4."""
    return F.md5(F.concat_ws("|", _col(source), _col(page_label), F.md5(_col(content).cast("binary"))).cast("binary"))


def chunk_id(source: Column, prefix: Column, label: Column, content: Column, index: Column | None = None, key: Column | None = None) -> Column:
    """CH- and 32 hex digits over the parts joined by unit separators; older rows leave out the index. `key`: the content's key where it is known."""
    parts = [source, prefix, label] + ([index.cast("string")] if index is not None else []) + [content_key(content) if key is None else key]
    return F.concat(F.lit("CH-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def tokenize(text: Column | str) -> Column:
    """runs of ASCII letters and digits, and single Chinese characters, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("([a-z0-9]+|[一-鿿])"), F.lit(1))


def token_ngrams(tokens: Column | str, n: int) -> Column:
    """all runs of n tokens joined by a space. The tokens are bound once: a lambda that named the expression would evaluate it for every run."""

    def runs(t: Column) -> Column:
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        out = F.slice(t, 1, count)
        for k in range(2, n + 1):
            out = F.zip_with(out, F.slice(t, k, count), lambda x, y: F.concat_ws(" ", x, y))
        return out

    return F.transform(F.array(_col(tokens)), runs)[0]


def bigrams(normal: Column | str) -> Column:
    """F7 of a column that holds F2 without spaces."""
    t = _col(normal)
    chars = F.split(t, "")
    pairs = F.zip_with(F.slice(chars, 1, F.length(t) - 1), F.slice(chars, 2, F.length(t) - 1), lambda x, y: F.concat(x, y))
    return F.when(F.length(t) >= 2, F.array_distinct(pairs)).otherwise(F.array(t))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """F8."""
    return F.size(F.array_intersect(_col(a), _col(b))) / F.size(F.array_union(_col(a), _col(b)))


def relevance_l2(a: Column | str, b: Column | str) -> Column:
    """1 - squared distance / sqrt(2)."""
    parts = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return 1 - F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.lit(2.0))


def conclusion_sentence(answer: Column | str) -> Column:
    """the first line of six characters or more, else the whole."""
    lines = F.transform(F.split(_col(answer), "\r\n|\n|\r"), lambda x: F.trim(x))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: F.length(x) >= 6), F.lit(1)), F.trim(_col(answer)), F.lit(""))


def classify_overclaim(answer: Column | str) -> Column:
    """the form of an answer's conclusion."""
    s = conclusion_sentence(answer)
    covers, excludes = s.rlike(COVERAGE), s.rlike(EXCLUSION)
    return (
        F.when(s == "", "UNKNOWN").when(s.rlike(BARE_PREFIX), "BARE_NEGATIVE").when(covers & ~excludes, "COVERAGE").when(s.rlike(BARE), "BARE_NEGATIVE")
        .when(excludes & s.rlike(SCOPE), "QUALIFIED_EXCLUSION").when(excludes, "BARE_NEGATIVE").when(covers, "COVERAGE").otherwise("UNKNOWN")
    )


def question_text(line: Column | str) -> Column:
    """the line without numbering."""
    return F.trim(F.regexp_replace(F.trim(_col(line)), r"^[0-9.、) ]+", ""))


def question_gate(line: Column | str) -> Column:
    """whether a candidate line is a question to keep."""
    q = question_text(line)
    return F.length(q).between(6, 120) & q.rlike("[一-鿿]") & q.rlike("|".join(QUESTION_MARKS)) & ~q.rlike(f"^[{DANGLING}]")


def has_cjk_or_kana(text: Column | str) -> Column:
    """F16."""
    return _col(text).rlike("[一-鿿぀-ヿ]")


def dotted_get(variant: Column | str, path: str, kind: str = "double") -> Column:
    """a value of a VARIANT by its dotted path."""
    return F.try_variant_get(_col(variant), f"$.{path}", kind)


def status_text(status: Column | str) -> Column:
    """F22."""
    names = F.create_map(*[F.lit(x) for pair in STATUS_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, _col(status).cast("int")), F.lit("unknown"))


def derive_upload_title(title: Column | str, filename: Column | str) -> Column:
    """F23."""
    stem = F.trim(F.replace(F.regexp_replace(_col(filename), r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.nullif(F.substring(F.trim(_col(title)), 1, 300), F.lit("")), F.nullif(stem, F.lit("")), F.lit("untitled"))


def arxiv_year(text: Column | str, form: str = ARXIV) -> Column:
    """The year of submission in an identifier, or null."""
    yy = F.nullif(F.regexp_extract(_col(text), form, 1), F.lit("")).cast("int")
    return F.when(yy >= 90, yy + 1900).otherwise(yy + 2000)


def arxiv_month(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(text), ARXIV, 2), F.lit("")).cast("int")


def arxiv_id(text: Column | str, form: str = ARXIV) -> Column:
    return F.nullif(F.regexp_extract(_col(text), form, 0), F.lit(""))


def title_year(title: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(title), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def derive_year(file: Column | str, title: Column | str, stored: Column | None = None, form: str = ARXIV) -> Column:
    """Identifier in the file's name, then in the title, then (at query time) the stored year, then the title."""
    steps = [arxiv_year(file, form), arxiv_year(title, form)] + ([stored] if stored is not None else []) + [title_year(title)]
    return F.coalesce(*steps)


def parse_year(text: Column | str) -> Column:
    """S14."""
    return F.substring(F.trim(_col(text)), 1, 4).try_cast("int")


def safe_name(name: Column | str, longest: int = 120) -> Column:
    """The base name in plain characters; the stem is cut so that the extension stays."""
    base = F.regexp_replace(F.regexp_replace(_col(name), r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "_")
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    return F.concat(F.substring(base, F.lit(1), F.least(F.length(base) - F.length(ext), longest - F.length(ext))), ext)


@F.pandas_udf(StringType())
def html_unescaped(text: pd.Series) -> pd.Series:
    """All named and numbered entities of HTML as characters."""
    return text.map(html.unescape, na_action="ignore")


def auto_title(metadata: Column | str, filename: Column | str) -> Column:
    """A real embedded title, else the file's stem without ' (n)' and underscores."""
    return resolved_title(F.lit(None).cast("string"), metadata, filename)["title"]


def resolved_title(manual: Column | str, metadata: Column | str, filename: Column | str) -> Column:
    """struct(title, origin): the title given by hand, else the embedded one unless it is blank or `none`, else the file's name."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = strip(html_unescaped(_col(metadata)))
    base = F.regexp_replace(_col(filename), r"^.*/", "")
    stem = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"\s*\(\d+\)$", ""), "_+", " "))
    real = (F.length(found) > 0) & (F.lower(found) != "none")
    made = lambda title, origin: F.struct(title.alias("title"), F.lit(origin).alias("origin"))
    return F.when(F.length(strip(_col(manual))) > 0, made(strip(_col(manual)), "manual")).when(real, made(found, "metadata")).otherwise(made(stem, "filename"))


def digit_share(text: Column | str) -> Column:
    """Digits over characters; a section above a quarter is a table."""
    return F.length(F.regexp_replace(_col(text), r"(?U)[^\d]+", "")) / F.greatest(F.length(_col(text)), F.lit(1))


def parse_sources(output: Column | str) -> Column:
    """title, prefix, page and score of each source block of a tool's output."""
    pattern = r"(?m)^\[source \d+ \| (.+?) \| (p|sec|blk)\.(\S+?) \| (?:relevance ([0-9.]+))?[^\]\n]*\]"
    get = lambda n: F.regexp_extract_all(_col(output), F.lit(pattern), F.lit(n))
    zipped = F.arrays_zip(get(1).alias("title"), get(2).alias("prefix"), get(3).alias("page"), get(4).alias("score"))
    return F.transform(zipped, lambda x: F.struct(x["title"].alias("title"), x["prefix"].alias("prefix"), x["page"].alias("page"), F.nullif(x["score"], F.lit("")).cast("double").alias("score")))
