"""Parsers of curated interaction files and of metadata records, as expressions over lines or JSON."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import vocab

# Terms of the molecular interaction vocabulary and mechanisms, with type, effect (and direction).
MI_TERMS = {
    "MI:0407": ("direct_binding", "binds", "undirected"),
    "MI:0915": ("proximal_association", "binds", "undirected"),
    "MI:0914": ("proximal_association", "binds", "undirected"),
    "MI:0217": ("post_translational", "phosphorylates", "A_to_B"),
    "MI:0194": ("post_translational", "cleaves", "A_to_B"),
    "MI:0220": ("post_translational", "ubiquitinates", "A_to_B"),
    "MI:0701": ("post_translational", "dephosphorylates", "A_to_B"),
    "MI:0213": ("post_translational", "methylates", "A_to_B"),
    "MI:0945": ("post_translational", "acetylates", "A_to_B"),
    "MI:0414": ("enzymatic", "catalyzes", "A_to_B"),
    "MI:0190": ("metabolic", "reacts_with", "undirected"),
    "MI:0569": ("transcriptional", "regulates", "A_to_B"),
    "MI:0571": ("post_translational", "cleaves", "A_to_B"),
}
OTHER_MI = ("unknown", "binds", "undirected")
MECHANISMS = {
    "phosphorylation": ("post_translational", "phosphorylates"),
    "dephosphorylation": ("post_translational", "dephosphorylates"),
    "ubiquitination": ("post_translational", "ubiquitinates"),
    "deubiquitination": ("post_translational", "deubiquitinates"),
    "acetylation": ("post_translational", "acetylates"),
    "deacetylation": ("post_translational", "deacetylates"),
    "methylation": ("post_translational", "methylates"),
    "demethylation": ("post_translational", "demethylates"),
    "sumoylation": ("post_translational", "sumoylates"),
    "neddylation": ("post_translational", "neddylates"),
    "glycosylation": ("post_translational", "glycosylates"),
    "cleavage": ("post_translational", "cleaves"),
    "palmitoylation": ("post_translational", "modifies"),
    "lipid modification": ("post_translational", "modifies"),
    "s-nitrosylation": ("post_translational", "modifies"),
    "oxidation": ("post_translational", "modifies"),
    "hydroxylation": ("post_translational", "modifies"),
    "stabilization": ("post_translational", "stabilizes"),
    "destabilization": ("post_translational", "destabilizes"),
    "binding": ("direct_binding", "binds"),
    "transcriptional regulation": ("transcriptional", "regulates"),
    "post transcriptional regulation": ("translational", "regulates"),
    "relocalization": ("transport", "localizes"),
    "small molecule catalysis": ("enzymatic", "catalyzes"),
    "guanine nucleotide exchange factor": ("enzymatic", "catalyzes"),
    "gtpase-activating protein": ("enzymatic", "catalyzes"),
    "chemical activation": ("signaling", "activates"),
    "chemical inhibition": ("signaling", "inhibits"),
}
GENERIC = ("binding", "transcriptional regulation", "post transcriptional regulation", "relocalization", "chemical activation", "chemical inhibition")


def accession(raw: Column) -> Column:
    """Upper case, cut at the first hyphen."""
    return F.split_part(F.upper(F.trim(raw)), F.lit("-"), F.lit(1))


def _mapped(key: Column, table: dict[str, tuple[str, ...]], default: tuple[str, ...], at: int) -> Column:
    return vocab.lookup({k: v[at] for k, v in table.items()}, key, default[at])


def psi_mitab(lines: DataFrame, with_label: bool = False) -> DataFrame:
    """Interactions of tab-separated lines with 14 columns or more between two known, different proteins; ``#`` lines are skipped."""
    cells = F.split("line", "\t", -1)
    rows = lines.where(~F.col("line").startswith("#") & (F.size(cells) >= 14)).select(cells.alias("c"))
    protein = lambda i: F.upper(F.regexp_extract(F.trim(F.get("c", F.lit(i))), r"(?i)^uniprotkb:([A-Z0-9]+)(-\d+)?$", 1))
    mi = F.get("c", F.lit(11))
    tokens = F.transform(F.split(F.get("c", F.lit(13)), r"\|", -1), lambda x: F.trim(x))
    named = F.filter(tokens, lambda x: x.startswith("reactome:"))
    papers = F.transform(F.filter(F.transform(F.split(F.get("c", F.lit(8)), r"\|", -1), lambda x: F.trim(x)), lambda x: x.startswith("pubmed:")), lambda x: F.substring(x, 8, 1000))
    out = rows.select(protein(0).alias("acc_a"), protein(1).alias("acc_b"), F.regexp_extract(mi, r'psi-mi:"(MI:\d+)"\((.+?)\)', 1).alias("mi_term"), F.regexp_extract(mi, r'psi-mi:"(MI:\d+)"\((.+?)\)', 2).alias("mi_label"), F.coalesce(F.substring(F.get(named, F.lit(0)), 10, 1000), F.get(tokens, F.lit(0))).alias("pathway_id"), F.array_join(papers, ",").alias("publications"))
    term = F.col("mi_term")
    out = out.where("acc_a != '' AND acc_b != '' AND acc_a != acc_b")
    out = out.withColumns({n: _mapped(term, MI_TERMS, OTHER_MI, i) for i, n in enumerate(("interaction_type", "effect", "direction"))})
    return out if with_label else out.drop("mi_label")


def signed_records(lines: DataFrame) -> DataFrame:
    """Signed interactions of tab-separated lines with 28 columns or more and a record id: both ends proteins of the protein database.

    The effect field has a sense: binds, activates, inhibits or none. A generic mechanism takes the
    sense as its effect, and becomes direct binding where that is binds. An unknown mechanism is
    signaling, or direct binding, by its sense; without one it is unknown and binds. The score is
    0.7 where it isn't a number, and within 0 to 1. Only direct binding is undirected."""
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    rows = lines.select(F.explode(F.array(F.split("line", "\t", -1))).alias("c"))  # split once: what is generated isn't put into each field
    rows = rows.where((F.size("c") >= 28) & (F.lower(at(1)) == "protein") & (F.lower(at(5)) == "protein") & (F.upper(at(3)) == "UNIPROT") & (F.upper(at(7)) == "UNIPROT") & (at(26) != ""))
    mechanism, raw = F.lower(at(9)), at(8)
    sense = F.when(F.contains(F.lower(raw), F.lit("form complex")), "binds").when(F.contains(F.lower(raw), F.lit("up-regulates")), "activates").when(F.contains(F.lower(raw), F.lit("down-regulates")), "inhibits")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(at(27).try_cast("double"), F.lit(0.7))))
    rows = rows.select(
        accession(at(2)).alias("acc_a"), accession(at(6)).alias("acc_b"), mechanism.alias("mechanism"), raw.alias("raw_effect"), sense.alias("sense"), F.nullif(at(21), F.lit("")).alias("publication"),
        at(26).alias("record"), score.alias("score"), vocab.curated_label(score).alias("label"), F.coalesce(F.nullif(at(13), F.lit("")), F.nullif(at(14), F.lit(""))).alias("context"),
    )
    table = [(m, kind, effect, m in GENERIC) for m, (kind, effect) in MECHANISMS.items()]
    known = lines.sparkSession.createDataFrame(table, "mechanism string, kind string, plain string, generic boolean")
    rows = rows.join(F.broadcast(known), "mechanism", "left")  # a closed list
    unknown, binds = F.col("kind").isNull(), F.col("sense") == "binds"
    kind = F.when(unknown, F.when(binds, "direct_binding").when(F.col("sense").isNotNull(), "signaling").otherwise("unknown")).when(F.col("generic") & binds, "direct_binding").otherwise(F.col("kind"))
    effect = F.when(unknown, F.coalesce("sense", F.lit("binds"))).when(F.col("generic"), F.coalesce("sense", "plain")).otherwise(F.col("plain"))
    out = rows.withColumn("interaction_type", kind).withColumn("effect", effect).withColumn("direction", F.when(F.col("interaction_type") == "direct_binding", "undirected").otherwise("A_to_B"))
    return out.where("acc_a != '' AND acc_b != '' AND acc_a != acc_b").drop("kind", "plain", "generic", "sense")


ENTRY = "primaryAccession string, comments array<struct<commentType: string, interactions: array<struct<interactantOne: struct<intActId: string>, interactantTwo: struct<uniProtKBAccession: string, intActId: string>, numberOfExperiments: int, organismDiffer: boolean>>>>"


def entry_interactions(entries: DataFrame) -> DataFrame:
    """Interactions of JSON entries, of the entry's own accession: within a species, of two different proteins, each unordered pair once.

    Of several the one with most experiments stays, then the first by its ids. A missing number of experiments is 1."""
    parsed = entries.select(F.from_json("entry", ENTRY).alias("e")).select(F.col("e.primaryAccession").alias("x"), F.explode("e.comments").alias("c"))
    each = parsed.where("c.commentType = 'INTERACTION'").select("x", F.explode("c.interactions").alias("i")).where("NOT coalesce(i.organismDiffer, false)")
    y = F.col("i.interactantTwo.uniProtKBAccession")
    ends = each.select("x", y.alias("y"), F.coalesce("i.numberOfExperiments", F.lit(1)).alias("n"), F.coalesce("i.interactantOne.intActId", F.concat(F.lit("noid-"), "x")).alias("own_id"))
    best = F.min(F.struct((-F.col("n")).alias("low"), "x", "own_id")).alias("best")
    pairs = ends.where("x != '' AND y != '' AND x != y").groupBy(F.least("x", "y").alias("acc_a"), F.greatest("x", "y").alias("acc_b")).agg(best)
    score, label = vocab.experiments_score(F.col("experiments"))
    return pairs.select("acc_a", "acc_b", (-F.col("best.low")).alias("experiments"), F.col("best.own_id").alias("record")).withColumn("score", score).withColumn("label", label)


ARTICLE = "id string, title string, abstract string, authors array<string>, journal string, year int, doi string, pmc_id string"


def _article(record: str | None) -> dict | None:
    """The fields of one XML record, with all text inside an element; None without an id."""
    try:
        root = ElementTree.fromstring(record or "")
    except ElementTree.ParseError:
        return None
    whole = lambda e: "".join(e.itertext()).strip()
    first = lambda path: next((e.text.strip() for e in root.iterfind(path) if e.text and e.text.strip()), None)
    own = first(".//PMID")
    if own is None:
        return None
    sections = [(e.get("Label", ""), whole(e)) for e in root.iterfind(".//AbstractText")]
    sections = [f"{label}: {text}" if label else text for label, text in sections if label or text]
    names = [((a.findtext("LastName") or ""), (a.findtext("ForeName") or "")) for a in root.iterfind(".//Author")]
    title, year, pmc = root.find(".//ArticleTitle"), first(".//PubDate/Year"), first(".//ArticleId[@IdType='pmc']")
    return {
        "id": f"pmid:{own}", "title": None if title is None else whole(title), "abstract": "\n\n".join(sections) or None,
        "authors": [", ".join(x for x in name if x) for name in names if name[0]], "journal": first(".//Journal/Title") or first(".//Journal/ISOAbbreviation"),
        "year": int(year) if year and year.isdigit() else None, "doi": first(".//ArticleId[@IdType='doi']"), "pmc_id": pmc.removeprefix("PMC") if pmc else None,
    }


def articles(records: DataFrame) -> DataFrame:
    """Papers of XML records (``record``): title, abstract (labelled sections parted by a blank line), authors, year, DOI and PMC id.

    Markup inside an element goes, its text stays, which is why the parser is Python. Records that can't be parsed or have no id go."""
    @F.pandas_udf(ARTICLE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in ARTICLE.split(", ")]
        return pd.DataFrame([_article(t) or {} for t in texts], columns=names).astype(object).where(lambda d: d.notna(), None)

    out = records.select(parse("record").alias("a")).select("a.*").where("id IS NOT NULL")
    return out.withColumn("full_text_available", F.col("pmc_id").isNotNull())


def paper_id(external: Column, own: Column) -> Column:
    """Sources agree on a paper's id where it has one of the literature database."""
    return F.when(F.coalesce(external, F.lit("")) != "", F.concat(F.lit("pmid:"), external)).otherwise(F.concat(F.lit("s2:"), own))


def seed_aliases(spark: SparkSession, rows: list[tuple[str, list[str], str]]) -> DataFrame:
    """(canonical, alias, entity_type) of a list of seeds."""
    return spark.createDataFrame([(c, a.lower().strip(), t) for c, aliases, t in rows for a in {c, *aliases} if a.strip()], "canonical string, alias string, entity_type string")
