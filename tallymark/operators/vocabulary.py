"""Concept vocabulary, relations and phrase families (JOIN-04..07).

The vocabulary is a configuration of fixed size, so tagging is a projection over
the text: no join, no shuffle. `tag_with_table` covers vocabularies that are
themselves data.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import constant_map, fold_literal, phrase_pattern, phrase_present
from .containment import contained_pairs

# Concept, label, aliases.
CONCEPTS = {
    "verification_validation": ("Verification and validation", (
        "v&v", "v and v", "verification and validation", "design verification", "product verification",
        "validation testing", "testing and validation", "test and validation", "technical testing",
    )),
    "test_engineering": ("Test engineering", (
        "test engineering", "test engineer", "testing", "test planning", "test execution", "test protocol",
        "test protocols", "test protocol development", "system testing", "product testing",
    )),
    "requirements_engineering": ("Requirements engineering", (
        "requirements engineering", "requirements documentation", "requirements management",
        "requirements traceability", "traceability matrix", "requirements analysis",
    )),
    "systems_engineering": ("Systems engineering", (
        "systems engineering", "systems engineer", "system engineering", "systems integration",
        "system integration", "system architecture",
    )),
    "quality_engineering": ("Quality engineering", (
        "quality engineering", "quality engineer", "quality assurance", "design assurance", "quality systems",
        "capa", "root cause analysis",
    )),
    "embedded_systems": ("Embedded systems", (
        "embedded systems", "embedded software", "firmware", "embedded c", "microcontroller programming",
        "hardware software integration",
    )),
    "software_development": ("Software development", (
        "software development", "software engineering", "programming", "application development", "coding",
    )),
    "python": ("Python", ("python",)),
    "django": ("Django", ("django",)),
    "matlab": ("MATLAB", ("matlab",)),
    "c_programming": ("C/C++ programming", ("c programming", "c++", "cpp", "embedded c")),
    "data_analysis": ("Data analysis", (
        "data analysis", "data analytics", "analyze data", "statistical analysis",
    )),
    "signal_processing": ("Signal processing", ("signal processing", "digital signal processing", "dsp")),
    "instrumentation": ("Biomedical/electronic instrumentation", (
        "instrumentation", "biomedical instrumentation", "medical instrumentation",
        "diagnostic instrumentation", "electronic instrumentation", "sensors", "sensor systems",
    )),
    "circuit_design": ("Circuit and electronics design", (
        "circuit design", "electronics design", "pcb design", "electrical design",
    )),
    "electrical_engineering": ("Electrical engineering", (
        "electrical engineering", "electrical engineer", "electronics engineering",
    )),
    "biomedical_engineering": ("Biomedical engineering", (
        "biomedical engineering", "biomedical engineer", "bioengineering",
    )),
    "computer_science": ("Computer science", ("computer science", "computer scientist")),
    "mechanical_engineering": ("Mechanical engineering", ("mechanical engineering", "mechanical engineer")),
    "medical_devices": ("Medical devices / MedTech", (
        "medical device", "medical devices", "medtech", "medical technology", "healthcare technology",
        "regulated medical product", "diagnostic device",
    )),
    "healthcare": ("Healthcare", ("healthcare", "health care", "clinical technology", "hospital technology")),
    "iso_13485": ("ISO 13485", ("iso 13485",)),
    "fda_design_controls": ("FDA design controls", ("fda design controls", "design controls", "21 cfr 820", "qsr")),
    "regulated_product_development": ("Regulated product development", (
        "regulated product development", "regulated environment", "regulated industry",
        "medical device regulations",
    )),
    "role_biomedical": ("Biomedical engineering roles", (
        "biomedical engineer", "biomedical engineering", "bioengineer",
    )),
    "role_medical_device": ("Medical-device engineering roles", (
        "medical device engineer", "medical devices engineer", "product engineer medical device",
    )),
    "role_systems": ("Systems engineering roles", ("systems engineer", "systems engineering", "system engineer")),
    "role_test": ("Test engineering roles", (
        "test engineer", "test engineering", "systems test engineer", "software test engineer",
        "manufacturing test engineer",
    )),
    "role_validation": ("Validation / V&V roles", (
        "validation engineer", "verification engineer", "v&v engineer", "verification and validation engineer",
    )),
    "role_quality": ("Quality / design-assurance roles", (
        "quality engineer", "quality engineering", "design assurance engineer",
    )),
    "role_software": ("Software engineering roles", (
        "software engineer", "software developer", "medical device software engineer",
    )),
    "role_clinical": ("Clinical engineering roles", ("clinical engineer", "clinical engineering")),
    "role_applications": ("Applications engineering roles", (
        "applications engineer", "application engineer", "field applications engineer",
    )),
    "role_reliability": ("Reliability engineering roles", ("reliability engineer", "reliability engineering")),
    "role_field_service": ("Field-service engineering roles", (
        "field service engineer", "service engineer", "biomedical equipment technician",
    )),
}

# Strength of related concepts, looked up in both directions.
RELATIONS = {
    "verification_validation": {
        "test_engineering": 0.80, "requirements_engineering": 0.65, "quality_engineering": 0.60,
    },
    "test_engineering": {
        "verification_validation": 0.80, "quality_engineering": 0.55, "systems_engineering": 0.55,
    },
    "requirements_engineering": {"systems_engineering": 0.75, "verification_validation": 0.65},
    "systems_engineering": {"requirements_engineering": 0.75, "test_engineering": 0.55},
    "quality_engineering": {
        "verification_validation": 0.60, "test_engineering": 0.55, "regulated_product_development": 0.60,
    },
    "embedded_systems": {"software_development": 0.65, "c_programming": 0.75, "circuit_design": 0.55},
    "software_development": {"python": 0.55, "django": 0.55, "embedded_systems": 0.55},
    "instrumentation": {
        "biomedical_engineering": 0.70, "electrical_engineering": 0.65, "circuit_design": 0.60,
    },
    "medical_devices": {
        "healthcare": 0.70, "biomedical_engineering": 0.75, "regulated_product_development": 0.70,
    },
    "healthcare": {"medical_devices": 0.70, "biomedical_engineering": 0.60},
    "electrical_engineering": {
        "biomedical_engineering": 0.55, "computer_science": 0.35, "mechanical_engineering": 0.35,
    },
    "biomedical_engineering": {"electrical_engineering": 0.55, "medical_devices": 0.75, "healthcare": 0.60},
    "iso_13485": {"regulated_product_development": 0.70, "fda_design_controls": 0.55},
    "fda_design_controls": {"regulated_product_development": 0.75, "iso_13485": 0.55},
    "role_biomedical": {"role_medical_device": 0.85, "role_systems": 0.55, "role_clinical": 0.65},
    "role_medical_device": {
        "role_biomedical": 0.85, "role_validation": 0.70, "role_quality": 0.65, "role_systems": 0.65,
    },
    "role_systems": {"role_validation": 0.70, "role_test": 0.65, "role_biomedical": 0.55},
    "role_test": {
        "role_validation": 0.85, "role_quality": 0.60, "role_systems": 0.65, "role_reliability": 0.60,
    },
    "role_validation": {
        "role_test": 0.85, "role_quality": 0.70, "role_systems": 0.70, "role_medical_device": 0.70,
    },
    "role_quality": {
        "role_validation": 0.70, "role_test": 0.60, "role_medical_device": 0.65, "role_reliability": 0.60,
    },
    "role_software": {"role_test": 0.55, "role_systems": 0.50},
    "role_clinical": {"role_biomedical": 0.65, "role_field_service": 0.60, "role_applications": 0.55},
    "role_applications": {"role_field_service": 0.65, "role_clinical": 0.55, "role_systems": 0.45},
    "role_reliability": {"role_test": 0.60, "role_quality": 0.60},
    "role_field_service": {"role_applications": 0.65, "role_clinical": 0.60},
}

# Phrase families, label and phrases.
FAMILIES = {
    "biosignal_instrumentation": ("Biosignal and instrumentation", (
        "physiological sensor", "physiological monitoring", "biomedical sensing", "sensor monitoring",
        "signal acquisition", "data acquisition", "diagnostic instrumentation", "medical instrumentation",
        "transducer", "biosignal", "patient monitoring",
    )),
    "verification_test": ("Verification and engineering test", (
        "bench evaluation", "bench testing", "design verification", "performance testing",
        "product characterization", "test protocol", "qualification testing", "verification testing",
        "validation testing", "engineering test",
    )),
    "software_test_automation": ("Software test and automation", (
        "automated tests", "automated testing", "test automation", "unit testing", "integration testing",
        "regression testing", "validation scripts", "continuous integration", "software verification",
        "software validation",
    )),
    "embedded_controls": ("Embedded software and controls", (
        "microcontroller", "embedded software", "embedded systems", "firmware", "real time software", "rtos",
        "device driver", "hardware software integration", "control algorithm", "motor control",
        "sensor integration",
    )),
    "regulated_development": ("Regulated product development", (
        "design history file", "design controls", "requirements traceability", "risk management",
        "quality system", "regulated development", "medical device documentation", "capa", "nonconformance",
        "verification documentation",
    )),
    "systems_requirements": ("Systems and requirements", (
        "system architecture", "requirements analysis", "requirements management",
        "requirements documentation", "interface definition", "system integration", "traceability matrix",
        "technical specifications", "cross functional integration",
    )),
    "backend_data_application": ("Backend and data-backed applications", (
        "django application", "web application", "database backed application", "backend development",
        "rest api", "relational database", "data model", "server side development", "application programming",
    )),
    "manufacturing_process": ("Manufacturing and process engineering", (
        "process development", "manufacturing line", "production equipment", "fixture design",
        "process validation", "iq oq pq", "production troubleshooting", "new product introduction",
        "design transfer",
    )),
    "quality_reliability": ("Quality and reliability", (
        "root cause analysis", "failure analysis", "reliability testing", "corrective action",
        "preventive action", "quality assurance", "design assurance", "supplier quality", "risk analysis",
    )),
}

# Titles that open a transferable path into the target industry (JOIN-06).
ENTRY_TERMS = (
    "product safety", "electrical safety", "quality engineer", "quality engineering", "design assurance",
    "validation engineer", "validation engineering", "verification engineer", "verification engineering",
    "v&v", "v and v", "test engineer", "test engineering", "systems engineer", "systems engineering",
    "manufacturing engineer", "manufacturing engineering", "process engineer", "process engineering",
    "new product introduction", "npi engineer", "reliability engineer", "reliability engineering",
    "regulatory engineer", "regulatory engineering", "compliance engineer", "compliance engineering",
    "product engineer", "product engineering", "product development", "research and development",
    "r&d engineer", "engineering technician", "clinical engineer", "clinical engineering",
    "applications engineer", "application engineer", "field service engineer",
)
SOFTWARE_TERMS = (
    "software engineer", "software engineering", "software developer", "software development",
    "medical device software", "healthcare software", "health technology software",
    "digital health software", "embedded software", "embedded systems", "firmware engineer",
    "firmware engineering", "firmware developer", "controls engineer", "controls engineering",
    "control systems engineer", "robotics software", "systems software", "software test engineer",
    "software testing", "test automation engineer", "test automation", "software validation engineer",
    "software verification engineer", "software quality engineer", "software quality assurance",
    "software design assurance", "software reliability engineer", "software integration engineer",
    "application software engineer", "clinical software engineer", "cybersecurity engineer",
    "product security engineer",
)


@dataclass(frozen=True)
class Vocabulary:
    """Concepts with aliases, their relations, and phrase families."""

    concepts: dict = field(default_factory=lambda: CONCEPTS)
    relations: dict = field(default_factory=lambda: RELATIONS)
    families: dict = field(default_factory=lambda: FAMILIES)

    def names(self, role: bool) -> list[str]:
        return [name for name in self.concepts if name.startswith("role_") == role]

    def concept_tags(self, norm: Column, role: bool = False) -> Column:
        """JOIN-04: sorted concepts whose aliases occur in an FN-01 text."""
        return self._tags(norm, {n: self.concepts[n][1] for n in sorted(self.names(role))}, False)

    def family_tags(self, norm: Column) -> Column:
        """JOIN-07: sorted families with a phrase between word boundaries."""
        return self._tags(norm, {n: self.families[n][1] for n in sorted(self.families)}, True)

    @staticmethod
    def _tags(norm, phrases, whole_words) -> Column:
        hits = [F.when(_any_phrase(norm, aliases, whole_words), F.lit(name)) for name, aliases in phrases.items()]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    def relation_rows(self, role: bool) -> list[tuple[str, str, float]]:
        """JOIN-05: both directions with the larger strength; a concept is not its own relation."""
        best: dict[tuple[str, str], float] = {}
        for left, others in self.relations.items():
            if left.startswith("role_") != role:
                continue
            for right, strength in others.items():
                for pair in ((left, right), (right, left)):
                    best[pair] = max(best.get(pair, 0.0), strength)
        return sorted((a, b, s) for (a, b), s in best.items())

    def relations_frame(self, spark: SparkSession, role: bool) -> DataFrame:
        return spark.createDataFrame(
            self.relation_rows(role) or [("", "", 0.0)], "required string, held string, strength double"
        )

    def label(self, concept: Column) -> Column:
        labels = constant_map({name: label for name, (label, _) in self.concepts.items()})
        return F.coalesce(labels[concept], concept)

    def family_label(self, family: Column) -> Column:
        labels = constant_map({name: label for name, (label, _) in self.families.items()})
        return F.coalesce(labels[family], family)


def _any_phrase(norm: Column, phrases, whole_words: bool = False) -> Column:
    """`phrase_pattern` of any phrase in an FN-01 text. A pattern is tried on texts that contain its phrase only."""
    tests = []
    for phrase in dict.fromkeys(fold_literal(p) for p in phrases):
        held = F.contains(norm, F.lit(phrase))
        bounded = whole_words or len(phrase) <= 3
        tests.append(held & norm.rlike(phrase_pattern([phrase], whole_words)) if bounded else held)
    return functools.reduce(Column.__or__, tests, F.lit(False))


def mentions(norm: Column, terms) -> Column:
    """JOIN-06: any fixed term contained in an FN-01 text."""
    return functools.reduce(Column.__or__, [F.contains(norm, F.lit(fold_literal(t))) for t in terms], F.lit(False))


def symmetric_relations(relations: DataFrame) -> DataFrame:
    """JOIN-05 for relations held as data: columns required, held, strength."""
    mirrored = relations.select(
        F.col("held").alias("required"), F.col("required").alias("held"), "strength"
    )
    return (
        relations.select("required", "held", "strength")
        .unionByName(mirrored)
        .groupBy("required", "held")
        .agg(F.max("strength").alias("strength"))
    )


def tag_with_table(texts: DataFrame, norm: str, aliases: DataFrame) -> DataFrame:
    """JOIN-04 for a vocabulary held as data: rows (norm, concept).

    `aliases` has columns concept and alias (FN-01 form). Blocked on the first
    characters of the alias, so no text meets every alias.
    """
    pairs = contained_pairs(
        texts.select(norm).distinct(), aliases.select("concept", "alias").distinct(), norm, "alias", (1, 2, 3, 5)
    )
    return pairs.where(phrase_present(F.col(norm), F.col("alias"))).select(norm, "concept").distinct()
