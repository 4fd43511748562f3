"""Text scans, column-name matching, treatments, label flow.

Scans are narrow: every document is read once, whole, inside the JVM. A finding
holds rule, category and line, never the matched text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalars import identifier, luhn_ok
from starloom.operators.lineage import propagate
from starloom.session import cut_lineage

# Signal rules as (rule, category, pattern). The patterns use Unicode
# word, digit and space classes.
RULES = (
    ("credential.private_key", "CREDENTIAL", r"(?U)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----"),
    ("credential.bearer", "CREDENTIAL", r"(?iU)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"),
    ("credential.provider_token", "CREDENTIAL", r"(?U)\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,})\b"),
    ("credential.assignment", "CREDENTIAL",
     r"""(?iU)\b(?:password|passwd|access_token|api_key|private_key|client_secret)\s*["']?\s*[:=]\s*["']?[^\s"'{}]{4,}"""),
    ("pii.email", "PII", r"(?iU)(?<![\w.+-])[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9](?:[A-Z0-9.-]*[A-Z0-9])?\.[A-Z]{2,}(?![\w.-])"),
    ("pii.ssn", "PII", r"(?U)(?<!\d)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)"),
    ("pci.authentication_value", "PCI", r"""(?iU)\b(?:cvv|cvc|card_verification_value|pin_code)\s*["']?\s*[:=]\s*["']?\d{3,6}\b"""),
    ("phi.contextual_value", "PHI",
     r"""(?iU)\b(?:patient_name|patient_id|medical_record_number|diagnosis|health_condition)[ \t]*["']?[ \t]*[:=][ \t]*["']?[^\s"'{}\[\],]{2,}"""),
    ("pii.synthetic_marker", "PII", r"(?U)\b(?:SYNTHETIC_PII_CANARY|PII_TEST_CANARY)\b"),
    ("pci.synthetic_marker", "PCI", r"(?U)\b(?:SYNTHETIC_PCI_CANARY|NOT_A_CARD_NUMBER_TEST_ONLY)\b"),
    ("phi.synthetic_marker", "PHI", r"(?U)\b(?:SYNTHETIC_PHI_CANARY|TEST_ONLY_NOT_PATIENT_DATA)\b"),
)
# Text without which a rule cannot match, looked for first because it is cheap.
# Lower-case words are looked for in case-folded text.
NEEDED_WORDS = {
    "credential.private_key": ("PRIVATE KEY-----",),
    "credential.bearer": ("bearer",),
    "credential.provider_token": ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"),
    "credential.assignment": ("password", "passwd", "access_token", "api_key", "private_key", "client_secret"),
    "pii.email": ("@",),
    "pci.authentication_value": ("cvv", "cvc", "card_verification_value", "pin_code"),
    "phi.contextual_value": ("patient_name", "patient_id", "medical_record_number", "diagnosis", "health_condition"),
    "pii.synthetic_marker": ("SYNTHETIC_PII_CANARY", "PII_TEST_CANARY"),
    "pci.synthetic_marker": ("SYNTHETIC_PCI_CANARY", "NOT_A_CARD_NUMBER_TEST_ONLY"),
    "phi.synthetic_marker": ("SYNTHETIC_PHI_CANARY", "TEST_ONLY_NOT_PATIENT_DATA"),
}
# Letters outside ASCII that match an ASCII letter when case is ignored, and that letter.
FOLDED_LETTERS = ("\u017f\u0131\u0130\u212a", "siik")
CASE_FOLDED = ("credential.bearer", "credential.assignment", "pci.authentication_value", "phi.contextual_value")
NEEDED_PATTERN = {"pii.ssn": r"(?U)\d{3}[- ]\d{2}[- ]\d{4}"}
# The card number pattern.
CARD = r"(?U)(?<!\w)(?:\d[ -]?){12,18}\d(?!\w)"
NEEDED_DIGITS = r"(?U)(?:\d[ -]?){12}\d"
CARD_RULE = ("pci.pan_candidate", "PCI")

# Private-use characters that mark a match's start and end inside a working copy of the text.
_START, _END, _OTHER = "\ue000", "\ue001", "\ue002"
_SEGMENT = f"{_START}?([a-f0-9]{{%d}}){_END}?"
# A UUID, marks allowed at its hyphens, unless a marked number runs on past its end.
_MARKED_UUID = (
    "(?iU)(?<![\\w-])" + "-".join(_SEGMENT % n for n in (8, 4, 4, 4, 12)) + f"(?![\\w-])(?![^{_START}{_END}]*{_END})"
)


def _clean(text: Column) -> Column:
    return F.translate(text, _START + _END, _OTHER * 2)


def _may_match(rule: str, text: Column, folded: Column) -> Column:
    where = folded if rule in CASE_FOLDED else text
    tests = [where.contains(w) for w in NEEDED_WORDS.get(rule, ())]
    if rule in NEEDED_PATTERN:
        tests.append(text.rlike(NEEDED_PATTERN[rule]))
    return reduce(lambda a, b: a | b, tests)


def _match_lines(rule: str, pattern: str, text: Column, folded: Column) -> Column:
    """Distinct 1-based lines on which a match starts; the pattern sees the whole text."""
    marked = F.regexp_replace(text, pattern, F.lit(_START + "$0"))
    lines = F.transform(F.split(marked, "\n"), lambda line, i: F.when(line.contains(_START), i + 1))
    found = F.array_compact(lines)
    return F.when(_may_match(rule, text, folded) & text.rlike(pattern), found).otherwise(F.array().cast("array<int>"))


def _card_lines(text: Column) -> Column:
    """Lines with a number that passes the checksum and is not part of a UUID.

    The pattern holds no line break, so numbers are looked for line by line.
    """
    def has_card(line: Column) -> Column:
        marked = F.regexp_replace(line, CARD, F.lit(f"{_START}$0{_END}"))
        kept = F.regexp_replace(marked, _MARKED_UUID, F.lit("$1-$2-$3-$4-$5"))
        numbers = F.regexp_extract_all(kept, F.lit(f"{_START}([^{_END}]*){_END}"), 1)
        return F.exists(numbers, luhn_ok)

    lines = F.transform(F.split(text, "\n"), lambda line, i: F.when(line.rlike(CARD) & has_card(line), i + 1))
    return F.when(text.rlike(NEEDED_DIGITS) & text.rlike(CARD), F.array_compact(lines)).otherwise(F.array().cast("array<int>"))


def _working(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """Text for matching, beside a copy in which every case variant of a letter is its lower-case form."""
    cleaned = df.select(*keep, F.col(text).alias("_raw"), _clean(F.col(text)).alias("_text"))
    return cleaned.withColumn("_folded", F.lower(F.translate("_text", *FOLDED_LETTERS)))


def _rule_lines(rules: Sequence[tuple[str, str, str]]) -> list[Column]:
    return [_match_lines(rule, pattern, F.col("_text"), F.col("_folded")) for rule, _, pattern in rules]


def _findings(df: DataFrame, keep: Sequence[str], text: str, rules: Sequence[tuple[str, str, str]], cards: bool) -> DataFrame:
    working = _working(df, keep, text)
    entry = lambda rule, category, lines: F.struct(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), lines.alias("lines"))
    found = [entry(rule, category, lines) for (rule, category, _), lines in zip(rules, _rule_lines(rules))]
    if cards:
        found.append(entry(*CARD_RULE, _card_lines(F.col("_text"))))
    hit = F.filter(F.array(*found), lambda e: F.size(e["lines"]) > 0)
    return working.select(*keep, F.explode(hit).alias("_e")).select(*keep, "_e.rule_id", "_e.category", F.explode("_e.lines").alias("line"))


def scan_text(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Every signal, card numbers included: keys, rule_id, category, line."""
    return _findings(df, keep, text, RULES, True)


def scan_signals(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    return _findings(df, keep, text, RULES, False)


def scan_cards(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    return _findings(df, keep, text, (), True)


def scan_status(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """clear / blocked / unsupported per document, every finding counted.

    A text that is missing or binary is unsupported; any other is complete, however
    many findings it has.
    """
    working = _working(df, keep, text)
    counts = [F.size(lines) for lines in (*_rule_lines(RULES), _card_lines(F.col("_text")))]
    total = reduce(lambda a, b: a + b, counts)
    readable = F.col("_raw").isNotNull() & ~F.col("_raw").contains("\x00")
    counted = working.select(*keep, readable.alias("_ok"), F.when(readable, total).otherwise(0).cast("long").alias("n_findings"))
    status = F.when(F.col("n_findings") > 0, "blocked").when(~F.col("_ok"), "unsupported").otherwise("clear")
    return counted.select(*keep, "n_findings", F.col("_ok").alias("is_complete"), status.alias("status"))


# Named character references of ASCII punctuation and the no-break space.
NAMED_REFERENCES = {
    "Tab": "\t", "NewLine": "\n", "excl": "!", "quot": '"', "num": "#", "dollar": "$", "percnt": "%", "apos": "'", "lpar": "(", "rpar": ")",
    "ast": "*", "plus": "+", "comma": ",", "period": ".", "sol": "/", "colon": ":", "semi": ";", "lt": "<", "equals": "=", "gt": ">", "quest": "?",
    "commat": "@", "lsqb": "[", "bsol": "\\", "rsqb": "]", "Hat": "^", "lowbar": "_", "grave": "`", "lcub": "{", "verbar": "|", "rcub": "}",
    "nbsp": "\u00a0", "amp": "&",
}
# A number may have any length and may lack its semicolon; a name needs one.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z]{2,8};)"


def unescape_html(html: Column) -> Column:
    """Character references decoded once; those of ``&`` itself are decoded last."""
    names = F.create_map(*[F.lit(v) for pair in NAMED_REFERENCES.items() for v in pair])

    def decoded(ref: Column) -> Column:
        body = F.regexp_replace(ref, "^&|;$", "")
        digits = F.regexp_replace(body, "^#[xX]?0*", "")
        hexed = body.rlike("^#[xX]")
        number = F.when(hexed & (F.length(digits) <= 6), F.conv(digits, 16, 10)).when(~hexed & body.startswith("#") & (F.length(digits) <= 7), digits).try_cast("int")
        legal = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(legal, number)), 8, "0")), "UTF-32")
        return F.coalesce(char, F.try_element_at(names, body), ref)

    is_ampersand = lambda ref: F.regexp_replace(ref, "^&|;$", "").rlike("^(?:amp|#0*38|#[xX]0*26)$")
    refs = F.array_distinct(F.regexp_extract_all(html, F.lit(_REFERENCE), 0))
    # Longer ones first: without its semicolon one reference may begin another.
    longest = lambda some: F.transform(F.array_sort(F.transform(some, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), lambda x: x["r"])
    ordered = F.concat(longest(F.filter(refs, lambda r: ~is_ampersand(r))), longest(F.filter(refs, is_ampersand)))
    return F.when(html.contains("&"), F.aggregate(ordered, html, lambda text, ref: F.replace(text, ref, decoded(ref)))).otherwise(html)


_JSON_SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/(?:ld\+)?json\b[^>]*>(.*?)</script"
_JSON_STRING = r'"((?:[^"\\]|\\.)*)"'
_JSON_PAYLOAD = r'(?i)"base64"\s*:\s*("(?:[^"\\]|\\.)*")'
_LOOKS_LIKE_JSON = r"^\s*(?:\{\s*[\"}]|\[\s*(?:[\"\[{0-9\-\]]|true\b|false\b|null\b))"
# An attribute's value: in double quotes, in single quotes, bare.
_DATA_URLS = (r'(?is)=\s*"\s*(data:[^"]*)"', r"(?is)=\s*'\s*(data:[^']*)'", r"(?is)=\s*(data:[^\s\"'>]+)")
_EMPTY = "array<string>"


def _decoded_strings(quoted: Column) -> Column:
    """JSON strings, quotes included, to their texts."""
    one = lambda q: F.coalesce(F.from_json(F.concat(F.lit("["), q, F.lit("]")), _EMPTY), F.array().cast(_EMPTY))
    return F.array_compact(F.flatten(F.transform(quoted, one)))


def _json_blocks(text: Column) -> Column:
    """JSON inside script elements, or the whole text where it is JSON."""
    return F.when(text.rlike(_LOOKS_LIKE_JSON), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(_JSON_SCRIPT), 1))


def _json_strings(text: Column) -> Column:
    """Decoded string values and keys of the JSON in a text."""
    return _decoded_strings(F.flatten(F.transform(_json_blocks(text), lambda b: F.regexp_extract_all(b, F.lit(_JSON_STRING), 0))))


def _embedded(text: Column) -> Column:
    """array<struct<fault, text>> of what ``data:`` values and ``base64`` keys hold: a fault or a decoded text."""
    markup = F.when(text.rlike(_LOOKS_LIKE_JSON), F.lit("")).otherwise(unescape_html(F.regexp_replace(text, _JSON_SCRIPT, "")))
    urls = F.concat(
        F.flatten(F.array(*[F.regexp_extract_all(markup, F.lit(p), 1) for p in _DATA_URLS])),
        F.filter(_json_strings(text), lambda t: F.lower(F.substring(t, 1, 5)) == "data:"))
    keyed = _decoded_strings(F.flatten(F.transform(_json_blocks(text), lambda b: F.regexp_extract_all(b, F.lit(_JSON_PAYLOAD), 1))))
    is_coded = lambda u: u.rlike(r"(?is)^data:[^,]*;base64[^,]*,")
    payload = F.concat(F.transform(F.filter(urls, is_coded), lambda u: F.regexp_replace(u, "(?is)^[^,]*,", "")), keyed)

    def opened(p: Column) -> Column:
        plain = F.make_valid_utf8(F.try_to_binary(p, F.lit("base64")).cast("string"))
        return F.struct(F.when(plain.isNull(), "coverage.invalid_base64").alias("fault"), plain.alias("text"))

    other = F.transform(F.filter(urls, lambda u: ~is_coded(u)), lambda u: F.struct(F.lit("coverage.unsupported_data_url").alias("fault"), F.lit(None).cast("string").alias("text")))
    return F.array_distinct(F.concat(F.transform(F.array_distinct(payload), opened), other))


def scan_html(df: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """Findings in the page, its decoded text, JSON strings and whatever is embedded, at any depth.

    ``part`` is page, json or data. Payloads are unpacked level by level until no
    text holds another: a payload is shorter than what holds it, and only the rows
    of payloads are written and moved on. One that cannot be read gives a coverage
    finding.
    """
    level = df.select(*keep, F.lit("page").alias("part"), F.col(html).alias("_text"))
    scanned, faults = [], []
    while True:
        own = F.transform(F.array_distinct(F.array(F.col("_text"), unescape_html(F.col("_text")))), lambda t: F.struct(F.col("part").alias("part"), t.alias("text")))
        inside = F.when(F.col("part") == "page", "json").otherwise("data")
        strings = F.transform(_json_strings(F.col("_text")), lambda t: F.struct(inside.alias("part"), t.alias("text")))
        scanned.append(level.select(*keep, F.explode(F.concat(own, strings)).alias("_p")).select(*keep, "_p.part", "_p.text"))
        held = level.where(F.col("_text").isNotNull()).select(*keep, F.explode(_embedded(F.col("_text"))).alias("_e")).select(*keep, "_e.fault", F.col("_e.text").alias("_text"))
        held = cut_lineage(held.distinct())
        if held.isEmpty():
            break
        faults.append(held.where("fault IS NOT NULL").select(*keep, F.lit("data").alias("part"), F.col("fault").alias("rule_id"), F.lit("COVERAGE").alias("category"), F.lit(None).cast("int").alias("line")))
        level = held.where("_text IS NOT NULL").select(*keep, F.lit("data").alias("part"), "_text")
    texts = reduce(lambda a, b: a.unionByName(b), scanned)
    found = scan_text(texts.where("text IS NOT NULL"), [*keep, "part"]).distinct()
    return reduce(lambda a, b: a.unionByName(b), [found, *[f.distinct() for f in faults]])


# One-word register entries that also match as a name's last word.
STRONG_WORDS = (
    "email", "phone", "mobile", "iban", "ssn", "passport", "surname", "firstname", "lastname",
    "dob", "birthdate", "postcode", "zipcode", "msisdn", "pan",
)


def match_columns(outputs: DataFrame, register: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Output names that equal a register word, or end in one that is compound or strong.

    ``outputs``: scope, identifier; ``register``: column_name; ``exemptions``:
    scope (``*`` for all), identifier. Each name yields its word suffixes, and the
    suffixes meet the register in one equi join.
    """
    words = register.select(identifier("column_name").alias("word")).where("word <> ''").distinct()
    words = words.withColumn("_suffix", F.col("word").contains("_") | F.col("word").isin(*STRONG_WORDS))
    named = outputs.select("scope", "identifier", identifier("identifier").alias("_name")).distinct()
    parts = F.split("_name", "_")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    cut = named.select("scope", "identifier", "_name", F.posexplode(suffixes).alias("_at", "word"))
    hits = cut.join(words, "word").where("_at = 0 OR _suffix")
    listed = exemptions.select(identifier("identifier").alias("_name"), F.col("scope").alias("_scope"))
    everywhere = listed.where("_scope = '*'").select("_name").distinct()
    local = listed.where("_scope <> '*'").select("_name", F.col("_scope").alias("scope")).distinct()
    left = hits.join(everywhere, "_name", "left_anti").join(local, ["_name", "scope"], "left_anti")
    return left.select("scope", "identifier", "word").distinct()


# Transformations that satisfy each treatment.
COMPATIBLE = {"mask": ("mask", "derive"), "tokenize": ("tokenize", "hash", "derive"), "aggregate": ("aggregate",)}


def treatment_status(df: DataFrame) -> DataFrame:
    """Declared treatment against observed evidence: satisfied / unresolved / violation with reasons.

    Input columns: treatment, transformation, review_reference, n_controls,
    expression_sha, output_expression_sha, output_transformation, lineage_complete.
    """
    c = F.col
    action = c("treatment")
    compatible = reduce(lambda a, b: a & b, [~((action == t) & ~c("transformation").isin(*ok)) for t, ok in COMPATIBLE.items()])
    declared = F.array_compact(F.array(
        F.when(action == "unresolved", "treatment.unresolved"),
        F.when(c("review_reference").isNull(), "treatment.review_missing"),
        F.when((action != "unresolved") & (c("transformation") == "unknown"), "treatment.transformation_unknown"),
        F.when((action == "retain_with_controls") & (c("n_controls") == 0), "treatment.controls_missing"),
        F.when(~compatible, "treatment.transformation_incompatible")))
    observed = F.array_compact(F.array(
        F.when(~F.coalesce(c("lineage_complete"), F.lit(False)), "lineage.unresolved"),
        F.when(c("expression_sha").isNotNull() & ~c("expression_sha").eqNullSafe(c("output_expression_sha")), "treatment.expression_changed"),
        F.when(action.isin(*COMPATIBLE) & c("expression_sha").isNull(), "treatment.expression_review_missing"),
        F.when(~c("transformation").eqNullSafe(c("output_transformation")), "treatment.transformation_unverified")))
    excluded = F.array(F.lit("treatment.excluded_source_reaches_output"))
    reasons = F.when(F.size(declared) > 0, declared).when(action == "exclude", excluded).otherwise(observed)
    status = F.when((F.size(declared) == 0) & (action == "exclude"), "violation").when(F.size(reasons) > 0, "unresolved").otherwise("satisfied")
    return df.withColumns({"status": status, "reasons": F.array_join(F.array_sort(reasons), ",")})


def assess_outputs(outputs: DataFrame, register: DataFrame, treatments: DataFrame) -> DataFrame:
    """violation / unresolved / within_declared_treatment per output.

    ``outputs``: output_id, destination, source_table, source_column, expression_sha,
    transformation, lineage_complete (one row per source column); ``register``:
    table_name, column_name; ``treatments``: the columns of ``treatment_status``
    plus table_name, column_name, destination. A treatment bound to the output's
    expression wins over a general one; anything but exactly one choice is unresolved.
    """
    known = register.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column")).distinct()
    hits = outputs.join(known, ["source_table", "source_column"], "left_semi")
    source = ["source_table", "source_column", "destination"]
    t = treatments.select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), "destination", "expression_sha",
        F.struct("treatment", "transformation", "review_reference", "n_controls", "expression_sha").alias("_t"))
    # Choices are folded per source first, so many outputs never meet many treatments.
    general = t.where("expression_sha IS NULL").groupBy(*source).agg(F.count("*").alias("_general"), F.min("_t").alias("_tg"))
    exact = t.where("expression_sha IS NOT NULL").groupBy(*source, F.col("expression_sha").alias("output_expression_sha")).agg(
        F.count("*").alias("_exact"), F.min("_t").alias("_te"))
    keys = ["output_id", "source_table", "source_column"]
    found = hits.select(
        *keys, "destination", "lineage_complete", F.col("expression_sha").alias("output_expression_sha"), F.col("transformation").alias("output_transformation"),
    ).join(general, source, "left").join(exact, [*source, "output_expression_sha"], "left").fillna(0, ["_general", "_exact"])
    one = F.when(F.col("_exact") == 1, F.col("_te")).when((F.col("_exact") == 0) & (F.col("_general") == 1), F.col("_tg"))
    picked = found.withColumn("_one", one).select(
        *keys, "lineage_complete", "output_expression_sha", "output_transformation", F.col("_one").isNull().alias("_unclear"), "_one.*")
    rated = treatment_status(picked).withColumn("status", F.when(F.col("_unclear"), "unresolved").otherwise(F.col("status")))
    per = rated.groupBy("output_id").agg(F.count_if(F.col("status") == "violation").alias("_v"), F.count_if(F.col("status") == "unresolved").alias("_u"))
    all_outputs = outputs.groupBy("output_id").agg(F.min(F.col("lineage_complete").cast("int")).alias("_l")).join(per, "output_id", "left")
    status = F.when(F.col("_v") > 0, "violation").when((F.col("_u") > 0) | (F.col("_l") == 0), "unresolved").otherwise("within_declared_treatment")
    return all_outputs.select("output_id", status.alias("status"))


def apply_treatments(df: DataFrame, treatments: Mapping[str, str], salt: str) -> DataFrame:
    """Mask, tokenise, drop or aggregate columns; the rest stay as they are.

    With ``aggregate`` columns no single row leaves: rows are grouped by what the
    other columns show, and each such column becomes its number of values, its sum,
    smallest and largest value (``<name>_count``, ``_sum``, ``_min``, ``_max``).
    """
    def out(name: str) -> Column | None:
        how = treatments.get(name, "retain_with_controls")
        if how in ("exclude", "aggregate"):
            return None
        if how == "mask":
            return F.mask(F.col(name).cast("string")).alias(name)
        if how == "tokenize":
            return F.sha2(F.concat(F.lit(salt), F.col(name).cast("string")), 256).alias(name)
        if how == "retain_with_controls":
            return F.col(name)
        raise ValueError(f"unknown treatment {how!r}")

    shown = [c for c in (out(n) for n in df.columns) if c is not None]
    folded = [n for n in df.columns if treatments.get(n) == "aggregate"]
    if not folded:
        return df.select(*shown)
    sums = [f(n).alias(f"{n}_{k}") for n in folded for k, f in (("count", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    return df.groupBy(*shown).agg(*sums)


# Sensitivities from lowest to highest, and the sensitive categories.
SENSITIVITIES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
CATEGORIES = ("PCI", "PHI", "PII")


def propagate_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after following all derivations ``source_id -> target_id``.

    ``labels``: node_id, sensitivity, categories array, deny, is_known. Highest
    sensitivity, union of categories, any deny; one unknown input makes the result unknown.
    """
    order = F.array(*[F.lit(s) for s in SENSITIVITIES])
    mask = reduce(lambda a, b: a + b, [F.when(F.array_contains("categories", c), 1 << i).otherwise(0) for i, c in enumerate(CATEGORIES)])
    start = labels.select(
        "node_id", F.array_position(order, F.col("sensitivity")).cast("int").alias("level"), mask.cast("int").alias("cats"),
        F.col("deny").cast("int").alias("deny"), (~F.col("is_known")).cast("int").alias("unknown"))
    done = propagate(start, edges, {"level": "max", "cats": "bit_or", "deny": "max", "unknown": "max"})
    names = F.array_compact(F.array(*[F.when(F.col("cats").bitwiseAND(F.lit(1 << i)) != 0, c) for i, c in enumerate(CATEGORIES)]))
    sensitivity = F.when(F.col("unknown") == 1, "UNKNOWN").otherwise(F.element_at(order, F.greatest("level", F.lit(1))))
    return done.select("node_id", sensitivity.alias("sensitivity"), F.array_join(names, ",").alias("categories"), (F.col("deny") == 1).alias("is_denied"))


def label_downgrades(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared labels below what their direct inputs require."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in SENSITIVITIES]), c).cast("int")
    inputs = labels.select(F.col("node_id").alias("source_id"), rank(F.col("sensitivity")).alias("_l"), F.col("categories").alias("_c"), F.col("deny").alias("_d"), F.col("is_known").alias("_k"))
    flat = edges.select("source_id", "target_id").distinct().join(inputs, "source_id")
    has = lambda c, col: F.array_contains(col, c)
    floor = flat.groupBy(F.col("target_id").alias("node_id")).agg(
        F.max("_l").alias("_floor"), F.max(F.col("_d").cast("int")).alias("_deny"), F.min(F.col("_k").cast("int")).alias("_known"),
        *[F.max(has(c, F.col("_c")).cast("int")).alias(f"_need_{c}") for c in CATEGORIES])
    j = labels.join(floor, "node_id")
    lost = reduce(lambda a, b: a | b, [(F.col(f"_need_{c}") == 1) & ~has(c, F.col("categories")) for c in CATEGORIES])
    codes = F.array_compact(F.array(
        F.when(F.col("_known") == 0, "unknown_input").when(rank(F.col("sensitivity")) < F.col("_floor"), "sensitivity_downgrade"),
        F.when(lost, "category_downgrade"), F.when((F.col("_deny") == 1) & ~F.col("deny"), "handling_downgrade")))
    return j.select("node_id", F.explode(codes).alias("finding"))


@dataclass(frozen=True)
class DestinationRule:
    """What may reach one destination."""

    sensitivities: tuple[str, ...]
    categories: tuple[str, ...] = ()
    is_approved: bool = True


def disclosure_decisions(items: DataFrame, policy: Mapping[str, DestinationRule]) -> DataFrame:
    """Reasons that keep an item from a destination; allowed when there is none.

    ``items``: item_id, sensitivity, categories array, review_status, lineage_status,
    handling map(destination -> allow/deny), scan_status. All destinations are
    judged in the item's own row, so the items are never shuffled.
    """
    def decide(destination: str, rule: DestinationRule) -> Column:
        held = F.array(*[F.lit(c) for c in rule.categories]) if rule.categories else F.array().cast("array<string>")
        reasons = F.array_sort(F.array_compact(F.array(
            F.when(F.lit(not rule.is_approved), "policy.unapproved"), F.when(F.col("review_status") != "approved", "classification.unapproved"),
            F.when(F.col("sensitivity") == "UNKNOWN", "classification.unknown"), F.when(F.col("lineage_status") != "complete", "lineage.unresolved"),
            F.when(~F.col("sensitivity").isin(*rule.sensitivities), "destination.sensitivity_denied"),
            F.when(F.size(F.array_except("categories", held)) > 0, "destination.categories_denied"),
            F.when(F.coalesce(F.try_element_at("handling", F.lit(destination)) != "allow", F.lit(True)), "destination.handling_not_allowed"),
            F.when(F.col("scan_status") != "clear", "scan.not_clear"))))
        return F.struct(F.lit(destination).alias("destination"), (F.size(reasons) == 0).alias("is_allowed"), F.array_join(reasons, ",").alias("reasons"))

    decisions = F.array(*[decide(d, r) for d, r in policy.items()])
    return items.select("item_id", F.explode(decisions).alias("_d")).select("item_id", "_d.*")
