"""DOI and journal of a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions import fixed_values as V
from loreline.functions.rules import PatternRule, RuleSet, first_segment
from loreline.functions.text import capitalise, contains_any, let


def clean_doi(c: Column) -> Column:
    """Trailing punctuation off, then the fragment, then the query."""
    c = F.regexp_replace(c, V.DOI_TRAILING, "")
    return F.substring_index(F.substring_index(c, "#", 1), "?", 1)


def cut_identifier(c: Column) -> Column:
    """Query and fragment off first, trailing dots after."""
    c = F.substring_index(F.substring_index(c, "?", 1), "#", 1)
    return F.rtrim(c, F.lit("."))


DOI_RULES = RuleSet(
    tuple(PatternRule(*row) for row in V.DOI_PATTERNS),
    {"clean": clean_doi, "cut": cut_identifier, "keep": lambda c: c},
)

# Prefixes of the publishers whose identifiers carry no DOI prefix themselves.
DOI_KINDS = {"nature": "10.1038/", "pii": "10.1016/j.", "lancet": "10.1016/", "elife": "10.7554/eLife."}


def build_doi(kind: str, identifier: Column) -> Column:
    """DOI from a publisher identifier."""
    value = cut_identifier(identifier) if kind == "lancet" else identifier
    return F.concat(F.lit(DOI_KINDS[kind]), value)


def doi_from_url(url: Column, rules: RuleSet = DOI_RULES) -> Column:
    """DOI by the first matching pattern; null for links that are not http."""

    def search(u: Column) -> Column:
        in_path = F.nullif(F.regexp_extract(u, V.DOI_IN_PATH, 1), F.lit(""))
        late = F.when(F.rlike(u, F.lit(V.GENOME_HOSTS)), clean_doi(in_path))
        return F.when(F.startswith(u, F.lit("http")), rules.apply(u).otherwise(late))

    return let(url, search)


def host_of(url: Column) -> Column:
    """Host in lower case without a leading www., '' when there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path in lower case, without query, fragment and last-segment parameters."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.regexp_replace(path, r";[^/]*$", ""))


def trends_journal(path: Column) -> Column:
    """Name of a Trends title from its path, plain `Trends` without one."""
    name = F.regexp_extract(path, r"/trends/([^/]+)/", 1)
    return F.when(name == "", F.lit("Trends")).otherwise(F.concat(F.lit("Trends in "), capitalise(name)))


def _journal(host: Column, path: Column, own_hosts=()) -> Column:
    trends = F.when(
        F.contains(host, F.lit("cell.com")) & F.contains(path, F.lit("/trends/")),
        trends_journal(path),
    )
    family = None
    for domain, table, default in V.HOST_FAMILIES:
        name = F.coalesce(first_segment(path, table), trends, F.lit(default))
        hit = F.contains(host, F.lit(domain))
        family = F.when(hit, name) if family is None else family.when(hit, name)
    skip = contains_any(host, (*V.NON_JOURNAL_HOSTS, *own_hosts))
    return F.when(~skip, F.coalesce(first_segment(host, V.SIMPLE_HOSTS), family))


def journal_by_domain(url: Column, own_hosts=()) -> Column:
    """Journal from host and path; null for hosts that are no journal."""
    place = F.struct(host_of(url).alias("host"), path_of(url).alias("path"))
    return let(place, lambda v: _journal(v["host"], v["path"], own_hosts))


def journal_by_doi_prefix(doi: Column) -> Column:
    """Journal of DOIs whose prefix names it."""
    chain = None
    for prefix, name in V.DOI_PREFIXES:
        hit = F.startswith(doi, F.lit(prefix))
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain


def journal_by_resolved_domain(resolved: Column, own_hosts=()) -> Column:
    """Journal of the address a DOI resolves to; the last resort is its first host label."""
    final = F.lower(resolved)
    place = F.struct(host_of(final).alias("host"), path_of(final).alias("path"))

    def name(v: Column) -> Column:
        host = v["host"]
        has = lambda part: F.contains(host, F.lit(part))
        bare = _journal(host, F.lit(""), own_hosts)
        label = F.nullif(capitalise(F.substring_index(host, ".", 1)), F.lit(""))
        return (
            F.when(has("biorxiv.org"), F.lit("bioRxiv"))
            .when(has("medrxiv.org"), F.lit("medRxiv"))
            .when(has("cell.com") | has("sciencedirect.com"), F.coalesce(bare, F.lit("Cell Press")))
            .when(has("nature.com"), F.coalesce(bare, F.lit("Nature Group")))
            .when(has("science.org"), F.lit("Science"))
            .when(has("pnas.org"), F.lit("PNAS"))
            .otherwise(F.coalesce(_journal(host, v["path"], own_hosts), label))
        )

    return let(place, name)
