"""Controlled vocabularies and the expressions that apply them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, signs, rules and aliases that results depend on.
EVIDENCE_WEIGHT = {
    "structural": 1.5, "in_vivo": 1.3, "in_vitro": 1.0, "curated_db": 0.9, "genetic_screen": 0.9,
    "clinical": 1.1, "co_expression": 0.6, "computational": 0.5, "unknown": 0.7,
}
EVIDENCE_QUALITY = {
    "structural": 1.0, "in_vivo": 0.9, "clinical": 0.85, "in_vitro": 0.75, "curated_db": 0.7,
    "genetic_screen": 0.65, "co_expression": 0.45, "computational": 0.35, "cited_claim": 0.35, "unknown": 0.3,
}
PENALTY = {"true_conflict": 1.0, "ambiguous": 0.5, "context_dependent": 0.0}
OPEN, UNRESOLVED = ("open", "reopened"), ("open", "investigating", "reopened")
ACTIVATING = (
    "activates", "activation", "promotes", "promotion", "upregulates", "upregulation", "upregulated", "upregulated in",
    "stimulates", "stimulation", "induces", "induction", "increases", "enhances", "enhancement", "stabilizes", "stabilises",
    "drives", "restores", "synergizes", "synergizes with", "synergy", "sensitizes", "improves", "ameliorates", "alleviates",
)
INHIBITING = (
    "inhibits", "inhibition", "suppresses", "suppression", "downregulates", "downregulation", "downregulated", "down-regulates",
    "blocks", "blocking", "represses", "repression", "decreases", "reduces", "reduction", "degrades", "destabilizes",
    "attenuates", "silences", "lowers", "impairs", "impedes",
)
NEUTRAL = (
    "regulates", "regulation", "modulates", "modulation", "affects", "binds", "binding", "interacts", "interaction", "reacts_with",
    "phosphorylates", "dephosphorylates", "ubiquitinates", "deubiquitinates", "deubiquitylates", "methylates", "demethylates",
    "acetylates", "deacetylates", "sumoylates", "glycosylates", "hydrolyzes", "catalyzes", "cleaves", "recruits", "localizes",
    "transports", "modifies", "modification", "unknown", "null", "",
)
ORGANISM_RULES = (
    (("human", "homo sapiens", "patient"), "human"),
    (("mouse", "murine", "mus musculus"), "mouse"),
    (("rat", "rattus norvegicus"), "rat"),
    (("mammal", "mammalian"), "mammal_unspecified"),
)
TISSUE_RULES = (
    (("hek293", "293t"), "cell_line:hek293"),
    (("hela",), "cell_line:hela"),
    (("mcf7", "mcf-7"), "cell_line:mcf7"),
    (("jurkat",), "cell_line:jurkat"),
    (("liver", "hepatic"), "tissue:liver"),
    (("lung", "pulmonary"), "tissue:lung"),
    (("t cell", "t-cell", "cd4+", "cd8+"), "cell_type:t_cell"),
    (("macrophage",), "cell_type:macrophage"),
)
CONDITION_RULES = (
    (("hypoxia", "hypoxic"), "hypoxia"),
    (("lps", "lipopolysaccharide"), "lps_stimulation"),
    (("serum starvation", "starved"), "serum_starvation"),
    (("tnf", "tnf-alpha", "tnfa"), "tnf_stimulation"),
    (("ifn", "interferon"), "interferon_stimulation"),
)
ASSAY_RULES = (
    (("co-ip", "coip", "co immunoprecipitation", "co-immunoprecipitation"), "protein_interaction:coip"),
    (("western blot", "immunoblot"), "protein_detection:western_blot"),
    (("rna-seq", "rnaseq"), "expression:rnaseq"),
    (("chip-seq", "chip seq"), "binding:chip_seq"),
    (("cryo-em", "cryo em"), "structure:cryo_em"),
    (("mass spec", "mass spectrometry"), "proteomics:mass_spectrometry"),
)
INTERACTION_ALIASES = {
    "direct_binding": ("binding", "protein_binding", "physical_interaction"),
    "proximal_association": ("physical_association", "association"),
    "post_translational": ("phosphorylation", "phosphorylates", "ubiquitination", "ubiquitinates", "acetylation", "methylation", "sumoylation", "cleavage", "proteolysis"),
    "transcriptional": ("transcription_regulation", "expression_regulation"),
    "translational": ("translation_regulation",),
    "unknown": ("inhibits", "inhibition", "activates", "activation", "induces", "promotes", "suppresses", "upregulates", "downregulates", "regulates", "regulation", "modulates"),
}
ENTITY_ALIASES = {
    "cell_type": ("tissue_cell_type", "cell"),
    "unknown": ("treatment",),
    "molecule": ("peptide", "drug", "small_molecule", "chemical", "compound", "vitamin", "supplement", "steroid", "lipid", "fatty_acid", "ion", "nucleotide", "amino_acid", "sugar", "glycan", "carbohydrate", "cofactor", "hormone_small_molecule"),
    "complex": ("protein_complex",),
    "rna": ("mrna", "mirna", "lncrna", "ncrna"),
    "modification": ("post_translational_modification", "ptm", "phosphorylation", "acetylation", "methylation", "ubiquitination", "sumoylation", "glycosylation"),
    "structure": ("organelle", "subcellular_structure", "anatomical_structure", "tissue", "organ"),
    "pathogen": ("virus", "bacteria", "bacterium", "fungus", "parasite", "microorganism"),
    "symbiont": ("commensal", "microbiome", "probiotic"),
    "protein": ("enzyme", "kinase", "phosphatase", "protease", "receptor", "ion_channel", "transporter", "cytokine", "chemokine", "growth_factor", "transcription_factor", "antibody", "hormone_protein", "hormone", "neuropeptide", "adaptor_protein", "scaffold_protein", "chaperone", "ligand"),
}
NON_MAMMALIAN = (
    "arabidopsis", "oryza sativa", "zea mays", "solanum", "nicotiana", "glycine max", "triticum", "hordeum", "populus", "physcomitrella",
    "saccharomyces", "schizosaccharomyces", "candida", "aspergillus", "neurospora", "cryptococcus", "pichia",
    "drosophila", "aedes", "anopheles", "bombyx", "tribolium", "caenorhabditis", "c. elegans",
    "danio rerio", "zebrafish", "oryzias", "medaka", "tetraodon", "takifugu", "fundulus", "salmo", "oncorhynchus", "xenopus", "ambystoma",
    "gallus gallus", "chicken", "meleagris", "taeniopygia", "escherichia", "bacillus", "staphylococcus", "streptococcus", "pseudomonas",
    "mycobacterium", "salmonella", "helicobacter", "listeria", "campylobacter", "vibrio", "clostridium", "methanococcus", "halobacterium", "sulfolobus",
)


def lookup(table: dict[str, float | int | str], key: Column, default) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sign(effect: Column) -> Column:
    """+1, -1, or 0 for neutral, unknown and null effects."""
    key = F.lower(strip(F.coalesce(effect, F.lit(""))))
    return F.when(key.isin(*ACTIVATING), 1).when(key.isin(*INHIBITING), -1).otherwise(0)


def is_mapped(effect: Column) -> Column:
    return F.lower(F.trim(F.coalesce(effect, F.lit("")))).isin(*ACTIVATING, *INHIBITING, *NEUTRAL)


def normalise(value: Column, rules, prefix: str) -> Column:
    """The first rule with a needle in the value; else prefix:slug; null for nothing."""
    low = strip(F.lower(value))
    out = F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
    for needles, name in rules:
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(low, F.lit(needle))
        out = out.when(found, name)
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return out.when(slug != "", F.concat(F.lit(f"{prefix}:"), slug))


def enum(value: Column, aliases: dict[str, tuple[str, ...]], fallback: str = "unknown") -> Column:
    low = F.translate(strip(F.lower(value)), " -", "__")
    out = F.when(value.isNull() | (value == ""), fallback)
    for name, others in aliases.items():
        out = out.when(low.isin(*others), name)
    return out.otherwise(low)


def clamp(value: Column) -> Column:
    """A number within 0 to 1; what isn't a number is 0.3."""
    number = value.try_cast("double")
    return F.when(number.isNull(), 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def non_mammalian(organism: Column) -> Column:
    return F.lower(F.coalesce(organism, F.lit(""))).rlike("|".join(map(re.escape, NON_MAMMALIAN)))


def recency(year: Column) -> Column:
    return F.when(year >= 2022, 1.0).when(year >= 2018, 0.8).when(year >= 2010, 0.6).otherwise(0.4)


def experiments_score(n: Column) -> tuple[Column, Column]:
    """Confidence score and label of a curated record by its number of experiments."""
    return F.when(n >= 5, 0.9).when(n >= 3, 0.8).when(n >= 2, 0.7).otherwise(0.55), F.when(n >= 2, "high").otherwise("medium")


def curated_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")
