"""Parsers of database entries, answers of outside resolvers, search results and full texts."""

from __future__ import annotations

import re
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import strip_tags
from claimweave.sources.tabular import accession, paper_id

NAMES = "struct<fullName: struct<value: string>, shortNames: array<struct<value: string>>>"
ENTRY = (
    "primaryAccession string, genes array<struct<geneName: struct<value: string>, synonyms: array<struct<value: string>>, orfNames: array<struct<value: string>>>>, "
    f"proteinDescription struct<recommendedName: {NAMES}, alternativeNames: array<{NAMES}>>, organism struct<scientificName: string>"
)
#: Parts of elements that are no text of an article.
NOISE = (
    "ref-list", "fig", "table-wrap", "supplementary-material", "ack", "fn-group", "author-notes", "funding-group", "permissions",
    "history", "pub-date", "journal-meta", "custom-meta-group", "kwd-group", "counts", "notes", "app-group", "app",
)
LEAST_FULL_TEXT = 200
PROTEINS, CHEMICALS = ("protein", "gene"), ("molecule", "metabolite")


def distinct_names(names: Column) -> Column:
    """The names without nulls and empty ones, each once whatever its case, as first written, in order."""
    given = F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.filter(given, lambda x, i: F.array_position(F.transform(given, F.lower), F.lower(x)) == i + 1)


def entry_entities(entries: DataFrame) -> DataFrame:
    """(accession, canonical_name, synonyms, organism) of JSON entries (``entry``).

    Names in order: each gene's name, synonyms and reading frames; the full name, its short ones, then other names. The canonical
    name is the first gene name, else the full name, else the first name of all, else the accession."""
    none = F.array().cast("array<string>")
    e = entries.select(F.from_json("entry", ENTRY).alias("e")).select("e.*")
    values = lambda a: F.coalesce(F.transform(a, lambda x: x["value"]), none)
    of_gene = lambda g: F.concat(F.array(g["geneName"]["value"]), values(g["synonyms"]), values(g["orfNames"]))
    of_name = lambda n: F.concat(F.array(n["fullName"]["value"]), values(n["shortNames"]))
    genes = F.coalesce(F.flatten(F.transform("genes", of_gene)), none)
    full = F.col("proteinDescription.recommendedName")
    others = F.coalesce(F.flatten(F.transform("proteinDescription.alternativeNames", of_name)), none)
    first_gene = F.get(F.filter(F.transform("genes", lambda g: g["geneName"]["value"]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    rows = e.select(F.col("primaryAccession").alias("accession"), distinct_names(F.concat(genes, F.when(full.isNotNull(), of_name(full)).otherwise(none), others)).alias("synonyms"), first_gene.alias("gene"), F.nullif(full["fullName"]["value"], F.lit("")).alias("full"), F.col("organism.scientificName").alias("organism"))
    return rows.select("accession", F.coalesce("gene", "full", F.get("synonyms", F.lit(0)), "accession").alias("canonical_name"), "synonyms", "organism")


def resolver_of(entity_type: Column) -> Column:
    """The outside source that knows entities of a type; null where none does."""
    return F.when(entity_type.isin(*PROTEINS), "uniprot").when(entity_type.isin(*CHEMICALS), "chebi")


def chosen_answers(answers: DataFrame, mammals: tuple[int, ...], human: int = 9606) -> DataFrame:
    """(name, canonical_name, accession, source) of the answers (name, source, place, taxon, canonical_name, accession) that are taken.

    Of proteins the first human one, else the first of a mammal, else the first; of chemicals the first. Answers without a name aren't taken."""
    taxon = F.when(F.col("source") != "uniprot", 0).when(F.col("taxon") == human, 0).when(F.col("taxon").isin(*mammals), 1).otherwise(2)
    named = answers.where("canonical_name != ''")
    best = named.groupBy("name", "source").agg(F.min(F.struct(taxon.alias("rank"), "place", "canonical_name", "accession")).alias("x"))
    return best.select("name", "x.canonical_name", "x.accession", "source")


def search_results(rows: DataFrame) -> DataFrame:
    """Papers of a literature search's JSON results (``result``), under the id that sources share; results without a title go."""
    kind = "paperId string, title string, abstract string, year int, authors array<struct<name: string>>, externalIds struct<PubMed: string, DOI: string>"
    r = rows.select(F.from_json("result", kind).alias("r")).where("r.title != ''")
    names = F.filter(F.transform("r.authors", lambda a: a["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return r.select(paper_id(F.col("r.externalIds.PubMed"), F.col("r.paperId")).alias("id"), "r.title", "r.abstract", names.alias("authors"), "r.year", F.col("r.externalIds.DOI").alias("doi"))


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[?!][^<>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][\w.:-]*)(?:\s[^<>]*?)?(?P<empty>/?)>", re.S)


def recovered(xml: str) -> ElementTree.Element | None:
    """The tree of broken markup: an end closes all that was opened within its element, one without a beginning is passed over, what is
    open at the end is closed, and other angle brackets and ampersands are text. None without any element."""
    builder, opened, at, any_element = ElementTree.TreeBuilder(), [], 0, False

    def text(value: str) -> None:
        if opened and value:  # text outside the first element is no part of it
            builder.data(value)

    for mark in MARK.finditer(xml):
        text(unescape(xml[at : mark.start()]))
        at, name = mark.end(), (mark["name"] or "").rpartition(":")[2]
        if mark["data"] is not None:
            text(mark["data"])
        elif name and mark["end"]:
            while name in opened:
                builder.end(last := opened.pop())
                if last == name:
                    break
            if not opened and any_element:
                break
        elif name:
            any_element = True
            builder.start(name, {})
            opened.append(name)
            if mark["empty"]:
                builder.end(opened.pop())
                if not opened:
                    break
    else:
        text(unescape(xml[at:]))
    for name in reversed(opened):
        builder.end(name)
    return builder.close() if any_element else None


def article_text(xml: str) -> str | None:
    """Title, abstract, headings, paragraphs and list items of an article, a blank line apart; None if it has no element. Broken markup is recovered.

    The text behind an element that is left out stays, on purpose: it is the paragraph's own."""
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        root = recovered(xml)
    if root is None:
        return None
    whole = lambda e: "".join(e.itertext()).strip()
    for parent in list(root.iter()):
        for child in [c for c in parent if _local(c) in NOISE]:
            before = list(parent).index(child)
            if child.tail and before:  # the text behind what goes stays
                parent[before - 1].tail = (parent[before - 1].tail or "") + child.tail
            elif child.tail:
                parent.text = (parent.text or "") + child.tail
            parent.remove(child)
    first = lambda name: next((whole(e) for e in root.iter() if _local(e) == name), "")
    out = [f"TITLE: {first('article-title')}" if first("article-title") else "", f"ABSTRACT:\n{first('abstract')}" if first("abstract") else ""]
    waiting = [e for e in root.iter() if _local(e) == "body"][:1]
    while waiting:
        at = waiting.pop(0)
        if _local(at) in ("sec", "body"):
            waiting = [*at, *waiting]
        elif _local(at) in ("title", "p"):
            out.append(whole(at))
        elif _local(at) in ("list", "def-list"):
            out += [whole(x) for x in at.iter() if _local(x) in ("p", "term", "def")]
    return "\n\n".join(x for x in out if x)


def full_texts(articles: DataFrame) -> DataFrame:
    """(id, full_text) of XML articles (id, xml): their text, or what is left without tags if they can't be parsed; texts of LEAST_FULL_TEXT characters or fewer go."""
    @F.pandas_udf("string")
    def parse(xml: pd.Series) -> pd.Series:
        return xml.map(lambda x: None if x is None else article_text(x))

    rows = articles.select("id", "xml", parse("xml").alias("parsed"))
    return rows.select("id", F.coalesce("parsed", strip_tags(F.col("xml"))).alias("full_text")).where(F.length("full_text") > LEAST_FULL_TEXT)


def seed_accessions(entities: DataFrame) -> DataFrame:
    """(accession, entity_id) of entities with an external id (``external_id``)."""
    return entities.where("external_id != ''").select(accession(F.col("external_id")).alias("accession"), F.col("id").alias("entity_id"))
