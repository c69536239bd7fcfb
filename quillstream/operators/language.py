"""Language profiles, detection by pattern density, and token multipliers."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, js, let, units

# Code, name, native name, token multiplier, confidence, patterns (without flags).
PROFILES = (
    ("en", "English", "English", 1.0, 1.0, (
        r"[a-zA-Z]{2,}",
        r"\b(the|is|are|was|were|have|has|had|do|does|did|a|an|and|or|but|in|on|at|to|for|of|with|be|this|that|from|as|by|they|we|you|he|she|it|not|can|will|would|could|should|may|might|must|hello|world)\b",
    )),
    ("es", "Spanish", "Español", 1.7, 0.9, ("[áéíóúüñ¿¡]", r"\b(el|la|los|las|un|una|de|en|que|y|es|por)\b")),
    ("fr", "French", "Français", 1.8, 0.9, ("[àâäéèêëïîôùûüÿç]", r"\b(le|la|les|un|une|de|et|est|à|en|que)\b")),
    ("de", "German", "Deutsch", 1.6, 0.9, ("[äöüß]", r"\b(der|die|das|den|dem|des|ein|eine|und|ist|in)\b")),
    ("zh", "Chinese", "中文", 2.0, 0.95, ("[一-鿿]", "[㐀-䶿]")),
    ("ja", "Japanese", "日本語", 2.5, 0.9, ("[぀-ゟ]", "[゠-ヿ]", "[一-鿿]")),
    ("ko", "Korean", "한국어", 2.3, 0.9, ("[가-힯]", "[ᄀ-ᇿ]")),
    ("ar", "Arabic", "العربية", 3.0, 0.85, ("[؀-ۿ]", "[ݐ-ݿ]")),
    ("ta", "Tamil", "தமிழ்", 4.5, 0.8, ("[஀-௿]",)),
    ("hi", "Hindi", "हिन्दी", 3.5, 0.85, ("[ऀ-ॿ]",)),
    ("ru", "Russian", "Русский", 1.9, 0.9, ("[Ѐ-ӿ]", r"\b(и|в|не|на|я|что|он|с|как|а)\b")),
    ("pt", "Portuguese", "Português", 1.7, 0.9, ("[àáâãäèéêëìíîïòóôõöùúûü]", r"\b(o|a|os|as|de|em|que|e|é|do|da)\b")),
    ("th", "Thai", "ไทย", 4.0, 0.8, ("[฀-๿]",)),
    ("vi", "Vietnamese", "Tiếng Việt", 1.5, 0.9, (
        "[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]",
        r"\b(và|của|có|là|này|được|trong|cho|người|từ|để|với|một|những|các|không|khi|trên)\b",
    )),
    ("id", "Indonesian", "Bahasa Indonesia", 1.4, 0.85, (
        r"\b(yang|dan|di|ke|dari|ini|itu|untuk|dengan|pada|adalah|tidak|ada|atau|akan|juga|oleh|dalam)\b",
    )),
)
SAMPLE = 500


def quick(pattern: str) -> str:
    """The pattern for Java, with a look at one character before the costly part:
    the first letters of a list of words, or any letter beyond ASCII for a class of such."""
    words = re.fullmatch(r"\\b\(([^()\[\]\\]+)\)\\b", pattern)
    if words:
        first = "".join(sorted({w[0] for w in words[1].split("|")}))
        return f"(?=[{first}]){js(pattern)}"
    if re.fullmatch(r"\[[^\x00-\x7f-]+\]", pattern):
        return f"(?=[^\\x00-\\x7F]){js(pattern)}"
    return js(pattern)


def profiles(spark: SparkSession) -> DataFrame:
    """The dimension table of languages."""
    rows = [(i, code, name, native, m, c, list(p)) for i, (code, name, native, m, c, p) in enumerate(PROFILES)]
    return spark.createDataFrame(
        rows, "seq int, code string, name string, native_name string, multiplier double, confidence double, patterns array<string>"
    )


def multiplier(code: Column) -> Column:
    """Token multiplier of a language; 1.0 for unknown ones."""
    out = F.lit(1.0)
    for name, _, _, m, _, _ in PROFILES:
        out = F.when(code == name, m).otherwise(out)
    return out


def _one(sample: Column, profile: tuple, seq: int) -> Column:
    """Confidence of one profile. Every count is made once."""
    code, _, _, m, base, patterns = profile
    counts = F.array(*(F.regexp_count(sample, F.lit(quick(p))) for p in patterns))

    def rate(c: Column) -> Column:
        total = functools.reduce(lambda a, b: a + b, (c[i] for i in range(len(patterns))))
        matched = functools.reduce(lambda a, b: a + b, ((c[i] > 0).cast("int") for i in range(len(patterns))))
        density = F.least(total / (F.greatest(units(sample), F.lit(1)) / 5.0), F.lit(1.0))
        return F.struct(matched.alias("matched"), (matched / float(len(patterns))).alias("share"), density.alias("density"))

    def judge(r: Column) -> Column:
        share, density = r["share"], r["density"]
        weight = F.when(density > 0.9, 0.4).otherwise(0.7)
        boost = F.when(share >= 1, F.lit(1.1)).otherwise(1.0)
        boost = F.when(density > 0.95, F.greatest(boost, F.lit(1.05))).otherwise(boost)
        conf = F.least((share * weight + density * (1 - weight)) * boost, F.lit(1.0)) * base
        return F.struct(conf.alias("conf"), F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(m).alias("multiplier"), r["matched"].alias("patterns"))

    return let(let(counts, rate), judge)


def detect_language(text: Column) -> Column:
    """Struct of code, confidence, multiplier and matched patterns; of equal
    confidences the later profile wins."""
    fixed = lambda conf: F.struct(F.lit("en").alias("code"), F.lit(conf).alias("confidence"), F.lit(1.0).alias("multiplier"), F.lit(0).alias("patterns"))

    def body(sample: Column) -> Column:
        best = F.greatest(*(_one(sample, p, i) for i, p in enumerate(PROFILES)))
        return let(
            best,
            lambda b: F.when(b["conf"] < 0.1, fixed(0.5)).otherwise(
                F.struct(b["code"].alias("code"), b["conf"].alias("confidence"), b["multiplier"].alias("multiplier"), b["patterns"].alias("patterns"))
            ),
        )

    return F.when(blank(F.coalesce(text, F.lit(""))), fixed(0.0)).otherwise(let(F.substring(text, 1, SAMPLE), body))


def detect_mixed(text: Column) -> Column:
    """Codes of all languages that any pattern finds, letters of either case;
    Japanese needs kana where Chinese is found too."""

    def body(s: Column) -> Column:
        hit = lambda p: s.rlike("(?iu)" + quick(p))
        found = [F.when(functools.reduce(lambda a, b: a | b, [hit(p) for p in patterns]), F.lit(code)) for code, _, _, _, _, patterns in PROFILES]
        kana = s.rlike("[぀-ヿ]")
        return let(
            F.array_compact(F.array(*found)),
            lambda a: F.when(F.array_contains(a, "zh") & F.array_contains(a, "ja") & ~kana, F.array_remove(a, "ja")).otherwise(a),
        )

    return let(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE), body)


def mixed_multiplier(codes: Column) -> Column:
    def body(m: Column) -> Column:
        mean = F.aggregate(m, F.lit(0.0), lambda a, x: a + x) / F.size(m)
        return F.when(F.size(m) == 0, 1.0).when(F.size(m) == 1, m[0]).otherwise(0.4 * mean + 0.6 * F.array_max(m))

    return let(F.transform(codes, multiplier), body)


def estimate_tokens(base: Column, language: Column) -> Column:
    return F.when(language["confidence"] < 0.3, base).otherwise(F.ceil(base * language["multiplier"])).cast("long")


def estimate_tokens_mixed(base: Column, codes: Column) -> Column:
    return F.ceil(base * mixed_multiplier(codes)).cast("long")


def encode_estimate(base: Column, language: Column) -> Column:
    """Adjusted count without the confidence guard, with what it was made from."""
    return F.struct(
        F.ceil(base * language["multiplier"]).cast("long").alias("tokens"), language["code"].alias("language"),
        language["confidence"].alias("confidence"), base.alias("base_tokens"), language["multiplier"].alias("multiplier"),
    )


def analyse(text: Column) -> Column:
    """Primary language, all languages, the mixed multiplier and whether it is mixed."""
    return let(
        detect_mixed(text),
        lambda codes: F.struct(
            detect_language(text)["code"].alias("primary"), codes.alias("languages"), mixed_multiplier(codes).alias("multiplier"), (F.size(codes) > 1).alias("is_mixed")
        ),
    )
