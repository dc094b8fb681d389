"""Content fingerprints (FN-17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, folded_text

UNIT = "\x1f"


def listing_text_sha256(text: Column) -> Column:
    return F.sha2(folded_text(text), 256)


def role_sha256(title: Column, company: Column, location: Column) -> Column:
    """Identity of a role; empty where the title or the company is blank."""
    t, c, l = folded_text(title), folded_text(company), folded_text(location)
    return F.when((t == "") | (c == ""), F.lit("")).otherwise(F.sha2(F.concat_ws(UNIT, t, c, l), 256))


def record_sha256(**fields: Column) -> Column:
    """Fingerprint of a record: canonical JSON with sorted keys."""
    named = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def claim_semantic_key(
    claim_type: Column, field_path: Column, section: Column, text: Column, heading: Column, subheading: Column
) -> Column:
    """What a claim is about: a field, a list value, or an entry's heading pair."""
    fold = lambda c: F.lower(F.trim(blank(c)))
    entry_head = F.concat_ws("|", F.lit("entry"), section, fold(heading), fold(subheading))
    entry_text = F.concat_ws("|", F.lit("entry"), section, fold(text))
    identity = (
        F.when(claim_type == "scalar", F.concat_ws("|", F.lit("scalar"), field_path))
        .when(claim_type == "list_item", F.concat_ws("|", F.lit("list"), field_path, fold(text)))
        .otherwise(
            F.when((fold(heading) != "") | (fold(subheading) != ""), entry_head).otherwise(entry_text)
        )
    )
    return F.sha2(identity, 256)
