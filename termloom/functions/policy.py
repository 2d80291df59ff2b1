"""Which aliases are safe for exact matching: an ordered CASE over patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.config import PolicyConfig

# The patterns that tell technical names, clinical codes and acronyms.
COMPLEX = r"(?iu)(\d+[a-z]?[-,])|(\([^)]+\))|(\[[^\]]+\])|([αβγδ])|(\b\d+h\b)"
STEREO = r"(?iu)(\(\s*[±+\-]\s*\))|(\([0-9rs*,\s]+\))|(\b[rs]-)|(\b[dl]-)"
PUNCTUATION = r"[-(),\[\];]"
CLINICAL_CODE = r"(?i)\b(fd\s*&?\s*c|d\s*&?\s*c|e\s*\d{3,4})\b"
FORMULA = r"(?i)\b[a-z]{1,3}\d+[a-z0-9()]*\b"
ACRONYM = r"^[A-Z]{2,6}$"


def classify(raw: Column, normalized: Column, cfg: PolicyConfig = PolicyConfig()) -> Column:
    """struct(category, safe, requires_context, reason); the first rule that applies decides."""
    raw, norm = F.trim(raw), F.trim(normalized)
    punctuation = F.size(F.regexp_extract_all(raw, F.lit(PUNCTUATION), F.lit(0)))
    stereo = raw.rlike(STEREO) & (punctuation >= 1)
    layered = (punctuation >= 3) & (raw.rlike(COMPLEX) | raw.rlike(FORMULA))
    technical = (F.length(norm) >= 18) & (stereo | layered | ((F.length(norm) >= 60) & (punctuation >= 2)))

    def out(category: str, safe: bool, context: bool, reason: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(safe).alias("safe"), F.lit(context).alias("requires_context"), F.lit(reason).alias("reason"))

    return (
        F.when(norm == "", out("unsafe", False, False, "empty_alias"))
        .when(F.regexp_replace(raw, "[^A-Za-z]", "").rlike(ACRONYM), out("unsafe", False, True, "short_acronym_alias"))
        .when(raw.rlike(CLINICAL_CODE) | norm.rlike(CLINICAL_CODE), out("clinical", True, False, "clinical_code_alias"))
        .when(F.length(F.replace(norm, F.lit(" "), F.lit(""))) < cfg.min_safe_alias_length, out("unsafe", False, True, "short_alias"))
        .when(technical, out("technical", cfg.include_technical_aliases, False, "technical_chemical_alias"))
        .otherwise(out("clinical", True, False, "clinical_alias"))
    )
