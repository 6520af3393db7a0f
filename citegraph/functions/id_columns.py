"""Reading identifiers out of a column of raw ids: aliases, and which provider entity an id names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citegraph.functions.columns import trim

# Address forms of a DOI.
DOI_URL = r"\Ahttps?://(?:dx\.)?doi\.org/"
# First letter of an OpenAlex id and the entity it names.
OPENALEX_LETTERS = {
    "W": "works", "A": "authors", "S": "sources", "I": "institutions", "T": "topics",
    "P": "publishers", "F": "funders", "C": "concepts",
}
# Provider prefixes as stored, and the form the provider's own ids take.
S2_PREFIXES = {
    "doi": "DOI", "corpusid": "CorpusId", "arxiv": "ARXIV", "mag": "MAG", "pmid": "PMID", "pmcid": "PMCID",
}
S2_NATIVE = ("DOI", "ARXIV", "CorpusId", "MAG", "PMID", "PMCID", "ACL", "DBLP", "URL")


def alias_struct(scheme: str | Column, value: Column) -> Column:
    return F.struct((F.lit(scheme) if isinstance(scheme, str) else scheme).alias("scheme"), value.alias("value"))


def strip_prefix(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "")


def bare_openalex(value: Column) -> Column:
    return strip_prefix(value, r"\Ahttps://openalex\.org/")


def bare_doi(value: Column) -> Column:
    return strip_prefix(value, r"\Ahttps://doi\.org/")


def parse_alias(raw: Column) -> Column:
    """STRUCT<scheme, value> of a raw id, null when it names no scheme.

    DOI addresses first, then `scheme:value` split at the first colon with the scheme in lower
    case, then a bare `10.…/…`.
    """
    split = r"(?s)\A([^:]*):(.*)\z"
    return (
        F.when(F.rlike(raw, F.lit(DOI_URL)), alias_struct("doi", strip_prefix(raw, DOI_URL)))
        .when(F.contains(raw, F.lit(":")), alias_struct(F.lower(F.regexp_extract(raw, split, 1)), F.regexp_extract(raw, split, 2)))
        .when(F.startswith(raw, F.lit("10.")) & F.contains(raw, F.lit("/")), alias_struct("doi", raw))
    )


def _entity(name: str | Column, id_: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("entity"), id_.alias("id"))


def openalex_entity(raw: Column) -> Column:
    """STRUCT<entity, id> an OpenAlex or external id names, null when it cannot be told."""
    id_ = F.regexp_replace(trim(raw), r"\A(?:https://openalex\.org/)+", "")
    letters = F.create_map(*[F.lit(x) for pair in OPENALEX_LETTERS.items() for x in pair])
    return (
        F.when(F.rlike(id_, F.lit(r"\A[WASITPFC][0-9]+\z")), _entity(F.element_at(letters, F.substring(id_, 1, 1)), id_))
        .when(F.rlike(id_, F.lit(r"\A(?:doi:|https://doi\.org/|pmid:|pmcid:|mag:)")), _entity("works", id_))
        .when(F.rlike(id_, F.lit(r"\A(?:orcid:|https://orcid\.org/)")), _entity("authors", id_))
        .when(F.startswith(id_, F.lit("issn:")), _entity("sources", id_))
        .when(F.startswith(id_, F.lit("ror:")), _entity("institutions", id_))
        .when(F.startswith(id_, F.lit("keywords/")), _entity("keywords", F.substr(id_, F.lit(10))))
    )


def s2_entity(raw: Column) -> Column:
    """STRUCT<entity, id>: papers or authors, with stored prefixes put into the provider's form."""
    id_ = trim(raw)
    out = F.when(F.startswith(id_, F.lit("s2author:")), _entity("authors", F.substr(id_, F.lit(10))))
    for prefix, native in S2_PREFIXES.items():
        rest = F.substr(id_, F.lit(len(prefix) + 2))
        out = out.when(F.startswith(id_, F.lit(prefix + ":")), _entity("papers", F.concat(F.lit(native + ":"), rest)))
    return (
        out.when(F.startswith(id_, F.lit("s2:")), _entity("papers", F.substr(id_, F.lit(4))))
        .when(F.rlike(id_, F.lit(rf"\A(?:{'|'.join(S2_NATIVE)}):")), _entity("papers", id_))
        .when(F.rlike(id_, F.lit(r"\A[0-9a-f]{40}\z")), _entity("papers", id_))
    )


def arxiv_id(raw: Column) -> Column:
    """Bare arXiv id without address, prefix or version; null when nothing is left."""
    bare = F.regexp_replace(trim(raw), r"\A(?:https?://arxiv\.org/abs/|arxiv:)", "")
    return F.when(bare != "", strip_version(bare))


def strip_version(id_: Column) -> Column:
    return F.regexp_replace(id_, r"(?s)v[0-9]+\z", "")
