"""Raw mail messages: header fields, MIME parts, transfer encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions.text import first_or_null, let, strip

BLANK_LINE = r"\r?\n\r?\n"
TAGGED_LINE = r"(?m)^Subject: \[paper\]"
# How far into a body without a declared boundary one is looked for (fixed value).
BOUNDARY_WINDOW = 3000


def split_message(raw: Column) -> Column:
    """A2: struct(headers, body) of a message whose first line is the separator.

    Null when there is no blank line or nothing above it.
    """
    parts = F.split(raw, BLANK_LINE, 2)
    headers = F.regexp_replace(F.get(parts, F.lit(0)), r"^[^\n]*\n?", "")
    body = F.get(parts, F.lit(1))
    return F.when(
        body.isNotNull() & (headers != ""),
        F.struct(headers.alias("headers"), body.alias("body")),
    )


def header(headers: Column, name: str) -> Column:
    """B2: value of a header field, name in any case, folded lines joined by a blank.

    The first field of that name counts; of directly adjoining ones the last.
    """
    unfolded = F.regexp_replace(headers, r"[ \t\r]*\n[ \t]+", " ")
    field = rf"(?imd)(?:^{name}:.*\n)*^{name}:(.*)$"
    return strip(F.regexp_extract(unfolded, field, 1))


def sender_address(value: Column) -> Column:
    """What stands in the first pair of angle brackets, else the whole value."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"<([^>]+)>", 1), F.lit("")), value)


def decode_qp(s: Column) -> Column:
    """H1: quoted-printable to text; bytes that are no UTF-8 become U+FFFD.

    Runs as percent decoding: valid escapes are rewritten first, soft line breaks
    dropped after, so that an escape never forms across a break.
    """
    s = F.regexp_replace(s, r"[^\x00-\x7F]", "?")
    s = F.regexp_replace(s, "==", "=3D")
    s = F.replace(F.replace(s, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    s = F.regexp_replace(s, r"=([0-9A-Fa-f]{2})", "%$1")
    s = F.regexp_replace(s, r"=(?:\n|\r[^\n]*\n?|\z)", "")
    return F.url_decode(s)


def decode_b64(s: Column) -> Column:
    """H2: base64 to text, characters outside the alphabet ignored; input on failure."""
    packed = F.regexp_replace(s, r"[^A-Za-z0-9+/=]", "")
    raw = F.try_to_binary(packed, F.lit("base64"))
    return F.coalesce(F.make_valid_utf8(raw.cast("string")), s)


def decode_part(body: Column, encoding: Column) -> Column:
    """A part by its transfer encoding; other encodings leave it as it is."""
    kind = F.lower(encoding)
    return (
        F.when(F.contains(kind, F.lit("base64")), decode_b64(body))
        .when(F.contains(kind, F.lit("quoted-printable")), decode_qp(body))
        .otherwise(body)
    )


def _start(body: Column, window: int | None) -> Column:
    return body if window is None else F.left(body, F.lit(window))


def boundary_of(content_type: Column, body: Column, window: int | None = BOUNDARY_WINDOW) -> Column:
    """The quoted MIME boundary of the header, else one in the first `window` characters of the body; or null."""
    pattern = r'(?i)boundary="([^"]+)"'
    declared = F.nullif(F.regexp_extract(content_type, pattern, 1), F.lit(""))
    repeated = F.regexp_extract(_start(body, window), pattern, 1)
    return F.coalesce(declared, F.nullif(repeated, F.lit("")))


def mime_pieces(body: Column, boundary: Column) -> Column:
    """array of [header, body] of the parts that have a header of their own."""
    pieces = F.split(body, F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E")))
    pieces = F.transform(pieces, lambda p: F.split(p, BLANK_LINE, 2))
    return F.filter(pieces, lambda p: F.size(p) == 2)


def select_body(body: Column, content_type: Column, encoding: Column, window: int | None = BOUNDARY_WINDOW) -> Column:
    """H3: the decoded text of a message; null for a multipart without a text part.

    Of several parts the first HTML or acceptable plain one counts. Plain parts are
    refused when the body itself starts with an HTML content type. A boundary or
    content type that the header does not name is sought in the first `window`
    characters of the body, with None in all of it.
    """
    own_type = header(_start(body, window), "Content-Type")
    plain_ok = ~F.contains(own_type, F.lit("text/html"))

    def multipart(boundary: Column) -> Column:
        # Only headers are looked at before one part is chosen; its body alone is trimmed and decoded.
        def is_text(p: Column) -> Column:
            return let(
                header(p[0], "Content-Type"),
                lambda t: F.contains(t, F.lit("text/html")) | (F.contains(t, F.lit("text/plain")) & plain_ok),
            )

        def read(p: Column) -> Column:
            text = strip(F.rtrim(strip(p[1]), F.lit("-")))
            return decode_part(text, header(p[0], "Content-Transfer-Encoding"))

        return let(first_or_null(F.filter(mime_pieces(body, boundary), is_text)), read)

    # One separator line that slipped in from the next message is dropped.
    single = F.array_join(F.split(decode_part(body, encoding), r"\nFrom[ -][^\n]*", 2), "\n")
    return let(
        boundary_of(content_type, body, window),
        lambda b: F.when(b.isNotNull(), multipart(b)).otherwise(strip(single)),
    )
