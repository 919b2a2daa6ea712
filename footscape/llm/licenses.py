"""License scan by ordered signature rules (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.common import lower_az

#: The base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: License names as words, the label, and a word or phrase without which no rule of that family fits.
NAMES = [
    ("gnu general public license", "gpl", "general public"), ("gnu lesser general public license", "lgpl", "general public"), ("gnu library general public license", "lgpl", "general public"),
    ("gnu affero general public license", "agpl", "general public"), ("gnu free documentation license", "gfdl", "documentation license"), ("apache license", "apache", "apache"),
    ("apache software license", "apache", "apache"), ("mit license", "mit", " mit "), ("expat license", "mit", "expat"), ("x11 license", "x11", "x11"), ("isc license", "isc", " isc "),
    ("bsd license", "bsd", " bsd "), ("2 clause bsd license", "bsd-2", " bsd "), ("3 clause bsd license", "bsd-3", " bsd "), ("4 clause bsd license", "bsd-4", " bsd "), ("zero clause bsd license", "0bsd", " bsd "),
    ("mozilla public license", "mpl", "mozilla"), ("eclipse public license", "epl", "eclipse"), ("eclipse distribution license", "edl", "eclipse"), ("european union public licence", "eupl", "european union"),
    ("common development and distribution license", "cddl", "common development"), ("common public license", "cpl", "common public"), ("artistic license", "artistic", "artistic"), ("boost software license", "bsl", "boost"),
    ("zlib license", "zlib", "zlib"), ("openssl license", "openssl", "openssl"), ("python software foundation license", "psf", "python software"), ("php license", "php", " php "), ("ruby license", "ruby", " ruby "),
    ("microsoft public license", "ms-pl", "microsoft"), ("microsoft reciprocal license", "ms-rl", "microsoft"), ("academic free license", "afl", "academic free"), ("open software license", "osl", "open software"),
    ("sil open font license", "ofl", "open font"), ("open database license", "odbl", "open database"), ("open data commons attribution license", "odc-by", "open data"), ("community data license agreement", "cdla", "community data"),
    ("do what the fuck you want to public license", "wtfpl", "you want to public"), ("unlicense", "unlicense", "unlicense"), ("beerware license", "beerware", "beerware"), ("university of illinois license", "ncsa", "university of illinois"),
    ("w3c software license", "w3c", "w3c"), ("postgresql license", "postgresql", "postgresql"), ("vim license", "vim", " vim "), ("server side public license", "sspl", "server side"), ("business source license", "busl", "business source"),
    ("elastic license", "elastic", "elastic"), ("creative commons zero", "cc0", "creative commons"), ("creative commons attribution", "cc-by", "creative commons"), ("cc by", "cc-by", " cc by"),
]
#: Short names that stand for a license before a version, with the label and the keyword.
SHORT = [("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gfdl", "gfdl"), ("mpl", "mpl"), ("epl", "epl"), ("eupl", "eupl"), ("cddl", "cddl"), ("ofl", "ofl"), ("odbl", "odbl"), ("apache", "apache"), ("sspl", "sspl"), ("busl", "busl")]
#: Creative Commons terms after "cc by" or "attribution".
CC_TERMS = [("nc", "noncommercial", "cc-by-nc"), ("sa", "sharealike", "cc-by-sa"), ("nd", "noderivatives", "cc-by-nd"), ("nc sa", "noncommercial sharealike", "cc-by-nc-sa"), ("nc nd", "noncommercial noderivatives", "cc-by-nc-nd")]
#: Notices that name no license, with their label, pattern and keyword.
NOTICES = [
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain"), ("all-rights-reserved", "all rights reserved", "rights reserved"), ("copyright-notice", "copyright (?:c )?(?:19|20)\\d\\d", "copyright"),
    ("permissive-text", "permission is hereby granted free of charge", "permission is"), ("permissive-text", "permission to use copy modify and or distribute", "permission to"), ("bsd", "redistribution and use in source and binary forms", "redistribution"),
    ("gpl", "under the terms of the gnu general public license", "general public"), ("warranty-disclaimer", "without warranties or conditions of any kind", "warranties"), ("warranty-disclaimer", "provided as is without warranty", "warranty"),
]


#: Every rule's words hold one of these; a text without any is passed over before the keywords.
GATE = ["licen", "gpl ", "gfdl ", " mpl ", " epl ", " eupl ", "cddl ", " ofl ", "odbl ", "apache ", "sspl ", "busl ", " cc by ", "creative commons ", " public domain ", " rights reserved ", "copyright ", "permission ", "redistribution ", "warrant"]


@dataclass(frozen=True)
class Rule:
    """A pattern over words between single spaces. Higher priority wins; `weight` is a detection's certainty."""

    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float
    base: bool = False


def rules() -> list[Rule]:
    """The base phrases, and per license name the statements that name it, by descending priority."""
    out = [Rule(label, phrase, next(k for n, x, k in NAMES if n == phrase and x == label), 5, 0.9, True) for phrase, label in BASE]
    version = "(?:version |v)?\\d{1,2}(?: \\d{1,2})?"
    for name, label, key in NAMES:
        out += [
            Rule(label, f"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}(?: {version})?", key, 4, 0.99),
            Rule(label, f"{name} {version}(?: (?:or|and) (?:any )?later)?", key, 3, 0.95),
            Rule(label, f"{name}(?: {version})? only", key, 3, 0.95),
            Rule(label, f"(?:see|under) the {name}", key, 2, 0.9),
            Rule(label, name, key, 1, 0.8),
        ]
    for short, label in SHORT:
        out += [Rule(label, f"{short} {version}", f" {short} ", 2, 0.8), Rule(label, f"spdx license identifier {short}(?: \\d)*", "spdx", 4, 0.99), Rule(label, f"{short} license", f" {short} ", 1, 0.7)]
    for short, long, label in CC_TERMS:
        out += [Rule(label, f"cc by {short}(?: \\d \\d)?", " cc by", 4, 0.99), Rule(label, f"creative commons attribution {long}(?: \\d \\d)?", "creative commons", 4, 0.99)]
    return out + [Rule(label, pattern, key, 1, 0.6) for label, pattern, key in NOTICES]


def normalised(text: Column) -> Column:
    """Words between single spaces, with a space on both sides; one space if there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(F.regexp_replace(lower_az(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))))


def _spaces(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


def _spans(norm: Column, rule: Column) -> Column:
    """Where a rule fits: structs of first and last word (from 0). Between two fits lies a gap; a running count of the
    spaces of gaps and fits gives the words before each."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    gaps = F.transform(F.split(norm, pattern, -1), _spaces)
    sizes = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), _spaces)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("found"))
    walk = F.aggregate(F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("g"), n.alias("n"))), nothing, lambda acc, x: F.when(x["n"].isNull(), acc).otherwise(F.struct(
        (acc["at"] + x["g"] + x["n"]).alias("at"),
        F.concat(acc["found"], F.array(F.struct((acc["at"] + x["g"] - 1).alias("first"), (acc["at"] + x["g"] - 1 + x["n"]).alias("last")))).alias("found"))))
    return walk["found"]


def detections(norm: Column, live: Column, ordered: list[Rule]) -> Column:
    """All fits of all rules whose keyword is among those that the text has, `live`: structs of first, last, priority, label, weight, base."""
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.keyword).alias("keyword"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base")) for r in ordered])
    return F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(live, r["keyword"])), lambda r: F.transform(_spans(norm, r), lambda s: F.struct(
        s["first"].alias("first"), (-s["last"]).alias("neg_last"), (-r["priority"]).alias("neg_priority"), r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base")))))


_FOUND = "array<struct<first:int,neg_last:int,neg_priority:int,label:string,weight:double,base:boolean>>"


def surviving(found: Column, priorities: list[int]) -> Column:
    """Detections without those whose words lie within another one of at least the same priority.

    They are walked in order of first word, longest first; for each priority the furthest last word so far
    is kept, so a detection is contained if that of its priority or a higher one reaches its end.
    """
    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in priorities], F.array().cast("array<struct<label:string,weight:double>>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        last, priority = -d["neg_last"], -d["neg_priority"]
        covered = F.lit(False)
        for p in priorities:
            covered = covered | ((priority <= p) & (acc[f"p{p}"] >= last))
        return F.struct(*[F.when((priority == p) & (last > acc[f"p{p}"]), last).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in priorities],
                        F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(d["label"].alias("label"), d["weight"].alias("weight"))))).alias("kept"))

    return F.aggregate(F.array_sort(found), start, step)["kept"]


def scan(docs: DataFrame, ordered: list[Rule] | None = None, gates: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of `docs` (doc_id, text, ...).

    A null or empty text has no words. Only texts that hold a string of GATE are matched with rules, and only with
    those of their keywords. Base phrases count at all their places, whatever suppresses them; `labels` are theirs
    and those of detections that survive. The score is one minus the product of the labels' doubts (the
    surest detection of each). With rules of one's own, `gates` must name a string of each. No label gives empty strings, null places and 0. All is done within a row, so repeated rows
    repeat and nothing is shuffled; other columns are ignored.
    """
    ordered = ordered or rules()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    gate = F.lit(False)
    for k in GATE if gates is None else gates:
        gate = gate | F.contains(F.col("norm"), F.lit(k))
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in ordered})])
    words = words.withColumn("n_words", (_spaces(F.col("norm")) - 1).cast("long")).withColumn(
        "live", F.when(gate, F.filter(keywords, lambda k: F.instr(F.col("norm"), k) > 0)).otherwise(F.array().cast("array<string>")))
    found = words.withColumn("found", F.when(F.size("live") > 0, detections(F.col("norm"), F.col("live"), ordered)).otherwise(F.array().cast(_FOUND))).drop("norm", "live")
    kept = found.withColumn("kept", F.when(F.size("found") > 0, surviving(F.col("found"), sorted({r.priority for r in ordered}))))
    base = F.filter("found", lambda d: d["base"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    out = kept.withColumn("base", base).withColumn("b", base_labels)
    own = F.coalesce(F.transform("kept", lambda d: d["label"]), F.array().cast("array<string>"))
    out = out.withColumn("l", F.array_sort(F.array_union("b", own)))
    sure = F.concat(F.transform("base", lambda d: F.struct(d["label"].alias("label"), d["weight"].alias("weight"))), F.coalesce("kept", F.array().cast("array<struct<label:string,weight:double>>")))
    out = out.withColumn("sure", sure)
    doubt = F.aggregate("l", F.lit(1.0), lambda acc, x: acc * (1 - F.array_max(F.transform(F.filter("sure", lambda d: d["label"] == x), lambda d: d["weight"]))))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"), F.array_join("b", ",").alias("base_labels"), F.array_join("l", ",").alias("labels"),
        F.when(F.size("l") > 0, 1 - doubt).otherwise(0.0).alias("score"))
