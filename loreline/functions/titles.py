"""Title and comment of a message, from its subject and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions import fixed_values as V
from loreline.functions.html import TAG, strip_style_script, unescape
from loreline.functions.links import without_addresses
from loreline.functions.text import collapse, first_or_null, let, letters, starts_with_any, strip


def is_boilerplate(line: Column) -> Column:
    """Greeting, signature, quoted header or a line with hardly any letters."""
    return let(
        strip(F.lower(line)),
        lambda t: (F.length(t) < 3)
        | t.isin(*V.BOILERPLATE_LINES)
        | starts_with_any(t, V.BOILERPLATE_STARTS)
        | (letters(t) < 3),
    )


def is_comment_subject(subject: Column) -> Column:
    """The subject is a remark about the item, not its title."""
    return let(
        F.lower(strip(subject)),
        lambda s: starts_with_any(s, (*V.COMMENT_MARKS, *V.COMMENT_PREFIXES))
        | F.rlike(s, F.lit(r"(?U)^(paper|here)\b")),
    )


def looks_like_title(text: Column) -> Column:
    """Length, first letter, word count and letter share of a title."""

    def wording(t: Column) -> Column:
        return (
            ~starts_with_any(t, (*V.COMMENT_PREFIXES, *V.GREETING_STARTS))
            & F.rlike(t, F.lit(r"(?U)\S+(?:\s+\S+){3}"))
            & ~F.rlike(t, F.lit(r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\."))
            & ~F.rlike(t, F.lit(r"\.(pdf|docx?|pptx?|xlsx?)$"))
            & (letters(t) >= F.length(t) * 0.4)
        )

    return (
        F.length(text).between(20, 300)
        & F.rlike(text, F.lit(r"^\p{Lu}"))
        & let(F.lower(text), wording)
    )


def _lines(body: Column) -> Column:
    return F.split(F.regexp_replace(body, TAG, "\n"), "\n")


def _title_line(line: Column) -> Column:
    return without_addresses(unescape(strip(line)))


def title_from_lines(body: Column) -> Column:
    """H15, line form: first title-like line once tags are line breaks."""
    lines = F.filter(
        F.transform(_lines(body), _title_line),
        lambda s: (strip(s) != "") & ~is_boilerplate(s),
    )
    return first_or_null(F.filter(F.transform(lines, collapse), looks_like_title))


def title_from_blocks(blocks: Column) -> Column:
    """H15, element form: first title-like text of a block element, in page order."""
    texts = F.filter(F.transform(blocks, without_addresses), lambda s: strip(s) != "")
    texts = F.transform(texts, lambda s: unescape(collapse(s)))
    return first_or_null(F.filter(texts, looks_like_title))


def comment_from_body(body: Column, title: Column, url: Column) -> Column:
    """What is left of a body without title, link and boilerplate lines."""
    text = unescape(F.regexp_replace(strip_style_script(body), TAG, "\n"))
    known = F.struct(
        collapse(title).alias("title"), F.rtrim(url, F.lit("/")).alias("link"), url.alias("url")
    )

    def kept(k: Column) -> Column:
        lines = F.filter(
            F.transform(F.split(text, "\n"), strip),
            lambda s: (s != "")
            & ~is_boilerplate(s)
            & (collapse(s) != k["title"])
            & (F.rtrim(s, F.lit("/")) != k["link"])
            & (s != k["url"]),
        )
        address = r"(?U)https?://\S+"
        lines = F.transform(
            lines,
            lambda s: F.when(
                F.contains(s, F.lit("://")), strip(F.regexp_replace(s, address, ""))
            ).otherwise(s),
        )
        return F.filter(lines, lambda s: F.length(s) >= 3)

    return collapse(F.array_join(let(known, kept), " "))


def resolve_title_comment(subject: Column, body: Column, url: Column, body_title: Column) -> Column:
    """struct(title, comment).

    A subject that is a remark changes places with the title of the body. A subject
    broken off by its encoding is completed from the body. Any other stays.
    `body` is the body without styles, scripts and signatures.
    """
    broken = F.endswith(subject, F.lit("=")) | F.contains(subject, F.lit("= "))
    stem = F.regexp_replace(F.rtrim(F.lower(collapse(subject)), F.lit("=")), r"(?U)\s+$", "")
    joined = F.lower(strip(F.regexp_replace(subject, r"(?U)\s*=\s*", " ")))
    low = F.lower(body_title)
    continued = F.startswith(low, stem) | F.startswith(low, F.left(joined, F.lit(40)))
    case = (
        F.when(F.coalesce(body, F.lit("")) == "", "empty")
        .when(is_comment_subject(subject), "remark")
        .when(body_title.isNotNull() & broken & continued, "completed")
        .otherwise("kept")
    )

    def result(kind: Column) -> Column:
        title = (
            F.when(kind == "remark", F.coalesce(body_title, subject))
            .when(kind == "completed", body_title)
            .otherwise(subject)
        )
        comment = (
            F.when(kind == "empty", F.lit(""))
            .when(kind == "remark", subject)
            .otherwise(comment_from_body(body, title, url))
        )
        return F.struct(title.alias("title"), comment.alias("comment"))

    return let(case, result)
