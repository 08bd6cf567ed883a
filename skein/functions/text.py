"""Text functions of the conversation graph as Column expressions: no Python runs on the rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word boundary that knows ASCII words alone, whatever the letters around.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Types that describe a person; words that carry no meaning in a label, and generic words of project labels.
SELF_MODEL = ["pattern", "principle", "agent_instruction", "preference", "decision"]
STOP_WORDS = ["and", "the", "for", "with", "from", "into", "that", "this", "over", "using", "based", "system", "project", "logic", "feature", "app"]
PROJECT_STOP_WORDS = ["project", "system", "pipeline", "feature", "app", "overhaul", "improvement", "integration", "implementation", "workflow"]
# Verbs that begin a narrow action.
ACTIONS = "add|adjust|ask|build|check|choose|compute|create|define|design|derive|determine|evaluate|explain|fetch|generate|implement|incorporate|map|move|prioritize|provide|refine|remove|replace|request|save|store|tailor|update|upload|use"

# Review categories, first match wins. Two categories that hold one person's own words are left out; a profile puts its own in front.
CATEGORY_RULES = [
    ("communication_style", "concise|terse|brief|tone|wording|communication|answer|response|bullet|bulleted"),
    ("writing_resume_pitch", "resume|linkedin|pitch|deck|slide|slides|investor|fundraising|email|message|caption|copy"),
    ("visual_design", "figma|visual|design|ui|ux|layout|screen|mockup|aesthetic|symmetry"),
    ("technical_workflow", "cursor|codex|claude|github|git|xcode|swift|typescript|react|implementation|code|technical|spec|prompt|json|schema|tool|workflow"),
    ("product_strategy", "product|strategy|positioning|wedge|mvp|founder|customer|market|pricing|growth|distribution"),
    ("lookup_behavior", "search|lookup|shopping|product|comparison|overview|recommendation|review|query|walmart|amazon|nike|harry'?s"),
]
# Source classes. All patterns of the first list must be found, none of the second; first match wins. Three names of one person's
# products are left out of the second lists, and the name of the application around the notes out of the tools: callers add theirs.
SOURCE_RULES = [
    ("shopping_product_lookup", ["product|products|shopping|shop|buy|walmart|amazon|target|nike|lulu|lululemon|harry'?s|razor|razors|shaving|costume", "price|prices|option|options|shopping|shop|buy|walmart|amazon|target|review|overview|recommendation|compare|comparison"], []),
    ("academic_problem", ["assignment|homework|class|course|quiz|exam|worksheet"], ["product|project|startup|plugin|app"]),
    ("academic_problem", ["problem|question|calculation|calculate|solve", "math|physics|chemistry|school|assignment|homework|answer|solution|top five"], ["assignment|homework|class|course|quiz|exam|worksheet", "product|project|startup|plugin|app"]),
    ("durable_profile", ["resume|linkedin|profile|bio|portfolio|personal website|about me|experience|education"], []),
    ("tool_workflow", ["cursor|codex|claude code|github|git|xcode|figma|plugin|mcp|vercel|firebase|firestore|node\\.?js|typescript|swift|react", "build|debug|fix|implement|integration|workflow|setup|configure|code|repo|repository|tool"], []),
    ("writing_workflow", ["rewrite|copy|caption|script|deck|slide|pitch|email|message|paragraph|wording|tone|resume|linkedin", "write|rewrite|draft|revise|edit|polish|shorten|summarize|communicate|copy"], []),
]
# How titles of look-ups read.
LOOKUP_TITLE = "comparison|critique|chat|exchange|explanation|greetings|guide|how[- ]to|overview|question|recommendation|recommendations|tip|tips|tutorial|walkthrough"
LOOKUP_START = "how|what|why|when|where|which|can|is|are|does|do|should|will|would|could|add|configure|create|debug|delete|disable|enable|export|find|fix|generate|group|import|install|move|remove|reorganize|run|search|setup|use"


def has_word(text: Column, words: str) -> Column:
    return text.rlike(f"(?i){B}(?:{words}){E}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it, and a small expression."""
    return F.transform(F.array(value), body)[0]


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def round_half_up(x: Column, digits: int = 2) -> Column:
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def hash_id(x: Column) -> Column:
    """32-bit multiply-by-33-and-xor hash of the UTF-16 units, in base 36."""

    def step(h: Column, unit: Column) -> Column:
        return (h * 33).bitwiseAND(F.lit(4294967295).cast("long")).bitwiseXOR(unit)

    def char(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        above = code - 65536
        return F.when(code < 65536, step(h, code)).otherwise(step(step(h, F.shiftright(above, 10) + 55296), above.bitwiseAND(F.lit(1023).cast("long")) + 56320))

    codes = F.filter(F.split(x, ""), lambda c: c != "")
    return F.lower(F.conv(F.aggregate(codes, F.lit(5381).cast("long"), char).cast("string"), 10, 36))


@cache
def plain_letters() -> tuple[str, str, str, str]:
    """What compatibility decomposition without combining marks makes of the characters that end in ASCII letters and digits:
    two strings for ``translate`` (marks and apostrophes at the end of the first, without a counterpart), the characters that become several, and a text c=...; of them."""
    one, many = {chr(c): chr(c + 32) for c in range(65, 91)}, {}
    for c in range(128, 0x30000):
        if 0xD800 <= c < 0xE000 or 0x300 <= c < 0x370:
            continue
        out = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not 0x300 <= ord(x) < 0x370).lower()
        if out != chr(c) and any(x.isascii() and x.isalnum() for x in out):
            if len(out) == 1 and c < 0x10000:
                one[chr(c)] = out
            else:
                many[chr(c)] = "".join(x if x.isascii() and x.isalnum() else "-" for x in out if x not in "'’")
    gone = "".join(map(chr, range(0x300, 0x370))) + "'’"
    return "".join(one) + gone, "".join(one.values()), "".join(many), "".join(f"{c}={v};" for c, v in many.items())


def coarse_ranges(chars: str, gap: int = 64) -> str:
    """A pattern's class of ranges that holds all the characters, and what lies in gaps of up to ``gap`` between them."""
    codes = sorted(map(ord, chars))
    starts = [c for k, c in enumerate(codes) if k == 0 or c - codes[k - 1] > gap]
    ends = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] - c > gap]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def slug(x: Column) -> Column:
    """Letters and digits as compatibility decomposition leaves them, without marks, lower case; runs of anything else as one hyphen; "untitled" if nothing is left."""
    of, to, many, table = plain_letters()

    def spelled(v: Column) -> Column:
        return F.array_join(F.transform(F.split(v, ""), lambda c: F.when(F.contains(F.lit(many), c) & (c != ""), F.split_part(F.split_part(F.lit(table), F.concat(c, F.lit("=")), F.lit(2)), F.lit(";"), F.lit(1))).otherwise(c)), "")

    def joined(v: Column) -> Column:
        whole = F.when(v.rlike(coarse_ranges(many)), spelled(v)).otherwise(v)  # a superset; few texts hold any of it
        return F.btrim(F.regexp_replace(F.translate(whole, of, to), "[^a-z0-9]+", "-"), F.lit("-"))

    # as lambdas, so that neither x nor the chain is computed twice
    return F.transform(F.transform(F.array(x), joined), lambda v: F.when(v == "", "untitled").otherwise(v))[0]


def file_name(x: Column, fallback: str = "Untitled") -> Column:
    spaced = F.regexp_replace(F.regexp_replace(x, r'[\\/:*?"<>|#^\[\]]', " "), r"\s+", " ")
    out = trim_all(F.substring(trim_all(spaced), 1, 96))
    return F.when(out == "", fallback).otherwise(out)


def truncated(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, max(0, most - 15)), r"\s+$", ""), F.lit("\n\n[truncated]")))


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 4).cast("long")


def masked_secrets(x: Column, most: int = 1000) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"sk-proj-[A-Za-z0-9_-]+", "sk-proj-[redacted]"), r"sk-[A-Za-z0-9_-]{8,}", "sk-[redacted]"), 1, most)


def singular(t: Column) -> Column:
    """Fixed synonyms, then plural endings."""
    known = F.when(t.isin("scoring", "scores"), "score").when(t == "features", "feature").when(t == "benchmarks", "benchmark").when(t == "weights", "weight").when(t == "tmobile", "mobile")
    return known.when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.expr("''"), F.regexp_replace(t, "ies$", "y"))).when(t.endswith("s") & (F.length(t) > 4) & ~t.endswith("ss"), F.regexp_replace(t, "s$", "")).otherwise(t)


def tokens_of(plain: Column) -> Column:
    """The significant tokens of a slug."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(F.split(plain, "-"), singular), lambda t: ((F.length(t) >= 3) | t.rlike("^[0-9]+$")) & ~F.array_contains(stop, t)))


def significant_tokens(label: Column) -> Column:
    return tokens_of(slug(label))


def project_part(tokens: Column) -> Column:
    """The slug of the tokens that name a project."""
    stop = F.array(*map(F.lit, PROJECT_STOP_WORDS))
    return F.array_join(F.slice(F.filter(tokens, lambda t: ~F.array_contains(stop, t)), 1, 5), "-")


def project_slug(label: Column) -> Column:
    return project_part(significant_tokens(label))


def name_strength(x: Column) -> Column:
    def one(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return one(x.rlike(r"(?i)\.[a-z0-9]{1,8}$") | x.rlike("[a-z][A-Z]"), 3) + one(x.rlike(f"{B}[A-Z]{{2,}}{E}"), 2) + one(x.rlike(rf"{B}The\s+[A-Z][a-z]+{E}"), 2) + one(x.rlike(rf"{B}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+{E}"), 1) + one(x.rlike("[0-9]"), 1)


def label_noise(x: Column) -> Column:
    return F.when(has_word(x, "chunk"), 10).otherwise(0) + F.when(F.length(x) > 80, 3).otherwise(0) + F.when(x.rlike("(?i)[^a-z0-9 ._-]"), 2).otherwise(0)


def narrow_action(x: Column) -> Column:
    return trim_all(x).rlike(f"(?i)^(?:{ACTIONS}){E}")


def review_category(x: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    out = None
    for name, words in rules or CATEGORY_RULES:
        out = F.when(has_word(x, words), name) if out is None else out.when(has_word(x, words), name)
    return out.otherwise("other")


def source_class(title: Column, text: Column) -> Column:
    out = None
    for name, need, bar in SOURCE_RULES:
        cond = F.lit(True)
        for p in need:
            cond &= has_word(text, p)
        for p in bar:
            cond &= ~has_word(text, p)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    lookup = trim_all(title).rlike(f"(?i)^(?:{LOOKUP_START}){E}") | has_word(title, LOOKUP_TITLE)
    return out.when(lookup, "transactional_lookup").otherwise("other")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of unequal length and zero norms."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


# Endings of file names, and words that follow a file's name in a label.
EXTENSIONS = "swift ts tsx js jsx py md json yaml yml toml rs go java kt h m mm cpp cc c css scss sass less html htm vue rb sh bash sql proto graphql gql lua php pl scala".split()
FILE_WORDS = r"source\s+file|source|implementation|code|impl|file|class|module|function|fn|view|controller"
# Labels that are evidence of a project rather than its name, words that name a lasting project, and further ones of clusters.
EVIDENCE_WORDS = "analysis|assignment|breakdown|deck|deliverable|funding|outline|pitch|planning|query|reference|research|resume|slide|slides|stack|ux|writeup"
PROJECT_WORDS = "agent|app|graph|platform|plugin|product|service|system|tool|vault|workflow|workstream"
CLUSTER_WORDS = ["agent", "automation", "backend", "database", "frontend", "graph", "platform", "plugin", "product", "vault", "workflow"]
# Words that say nothing about a review item.
REVIEW_STOP_WORDS = ["agent", "answer", "candidate", "context", "instruction", "memory", "output", "pattern", "preference", "principle", "review", "user", "uses", "use", "wants"]
# Families of traits, each with two lists of words of which one each must be found in label or summary; first match wins.
FAMILY_RULES = [
    ("Concise, high-density communication", "concise|terse|brief|brevity|short|dense|high-density", "copy|output|wording|answer|answers|response|responses|writing|communication|reply|replies|investor|slide|deck"),
    ("Structured bullet-based output", "bullet|bullets|bulleted|list|lists|structured", "output|format|response|summary|summaries|writing|copy|implementation|guidance"),
    ("Technically detailed implementation guidance", "technical|implementation|code|coded|spec|specs|engineering|developer|cursor|codex", "detail|detailed|specific|grounded|implementation|plan|guidance|prompt|prompts"),
]
# Domains that are no projects, by tokens of which one of each list must be found. A profile puts its own domains in front.
OTHER_DOMAINS = [
    ("phone-plan", [["family", "iphone", "phone", "carrier", "verizon", "mobile", "tmobile"]]),
    ("ai-job-research", [["job", "displacement"], ["role", "tech", "estimate", "career"]]),
    ("school-assignment", [["assignment", "homework", "class", "course"]]),
    ("school-assignment", [["top"], ["five"]]),
]


def clean_label(label: Column, title: Column) -> Column:
    """A label without its chunk's number; the title where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(label, r"(?i)\s+\(chunk\s+\d+\)$", ""), rf"(?i){B}chunk\s+\d+{E}", ""), r"\s+", " ")
    return F.coalesce(F.nullif(trim_all(out), F.lit("")), trim_all(F.regexp_replace(title, r"(?i)\s+\(chunk\s+\d+\)$", "")))


def filename_slug(label: Column) -> Column:
    """The slug of the first file name in a label; empty without one."""
    plain = trim_all(F.regexp_replace(trim_all(label), rf"(?i)\s+(?:{FILE_WORDS})$", ""))
    names = F.filter(F.split(plain, r"\s+"), lambda t: F.regexp_extract(F.lower(t), r"^[a-z0-9_]+\.([a-z0-9]{1,6})$", 1).isin(EXTENSIONS))
    stem = F.regexp_extract(F.get(names, F.lit(0)), r"^([A-Za-z0-9_]+)\.", 1)
    return F.when(trim_all(label).startswith("_") | (F.size(names) == 0), "").otherwise(slug(stem))


def graph_type(kind: Column, label: Column) -> Column:
    """The type that an item is filed under: styles are patterns, and what reads as a file is an artifact."""
    return F.when(kind == "style_pattern", "pattern").when(kind.isin("entity", "artifact") & (filename_slug(label) != ""), "artifact").otherwise(kind)


def domain_of(tokens: Column, domains: list[tuple[str, list[list[str]]]] | None = None) -> Column:
    """The first domain of which every list has one of the tokens; null for none."""
    out = None
    for name, lists in domains or OTHER_DOMAINS:
        cond = F.lit(True)
        for words in lists:
            cond &= F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def domain_key(text: Column, domains: list[tuple[str, list[list[str]]]] | None = None) -> Column:
    return let(significant_tokens(text), lambda t: domain_of(t, domains))


def read_label(label: Column) -> Column:
    """plain and tokens: a label's slug and its significant tokens, computed once."""
    return let(slug(label), lambda p: F.struct(p.alias("plain"), tokens_of(p).alias("tokens")))


def kind_of_project(label: Column, summary: Column, said: Column, told: Column, domains: list[tuple[str, list[list[str]]]] | None = None) -> Column:
    """(kind, domain) of a project's label, given ``read_label`` of the label and the tokens of the summary."""
    barred = [n for n, _ in OTHER_DOMAINS]
    clean = trim_all(label)

    def kind(t: Column) -> Column:
        evidence, lasting, domain = t["evidence"], t["lasting"], t["domain"]
        k = F.when(domain.isNull() | domain.isin(barred), "non_project").when(evidence, "domain_evidence").when(domain.startswith("custom:"), F.when(lasting, "durable_project").otherwise("domain_evidence"))
        return F.struct(k.otherwise(F.when(narrow_action(label), "domain_evidence").otherwise("durable_project")).alias("kind"), domain.alias("domain"))

    def domain(t: Column) -> Column:
        own = F.when(t["lasting"], F.concat(F.lit("custom:"), F.coalesce(F.nullif(project_part(said["tokens"]), F.lit("")), said["plain"])))
        return F.struct(t["evidence"].alias("evidence"), t["lasting"].alias("lasting"), F.coalesce(domain_of(said["tokens"], domains), domain_of(told, domains), own).alias("domain"))

    evidence = has_word(label, EVIDENCE_WORDS)
    lasting = (clean != "") & (F.length(clean) <= 90) & ~narrow_action(clean) & ~evidence & (F.size(said["tokens"]) >= 2) & has_word(F.concat_ws(" ", clean, summary), PROJECT_WORDS)
    return let(let(F.struct(evidence.alias("evidence"), lasting.alias("lasting")), domain), kind)


def project_kind(label: Column, summary: Column, domains: list[tuple[str, list[list[str]]]] | None = None) -> Column:
    """(kind, domain) of a project's label: durable_project, domain_evidence or non_project."""
    return let(F.struct(read_label(label).alias("said"), significant_tokens(summary).alias("told")), lambda t: kind_of_project(label, summary, t["said"], t["told"], domains))


def match_keys(kind: Column, label: Column, product: Column | None = None) -> Column:
    """The keys under which a label of a type is found, the surest first. product: the product that a label names, by the profile's own rules (empty: none)."""
    other = kind != "project"

    def key(name: str, value: Column, cond: Column) -> Column:
        return F.when(cond & (value != ""), F.concat(kind, F.lit(f":{name}"), value))

    def keys(t: Column) -> Column:
        plain, tokens = t["said"]["plain"], F.array_join(t["said"]["tokens"], "-")
        out = [key("", plain, F.lit(True)), key("normalized:", tokens, tokens != plain)]
        out += [key("app-product:", product, other)] if product is not None else []
        out += [key("filename:", t["file"], other), key("project-domain:", t["domain"], ~other), key("project-normalized:", project_part(t["said"]["tokens"]), ~other)]
        return F.array_distinct(F.array_compact(F.array(*out)))

    none = F.array().cast("array<string>")
    # what only projects or only other types need is computed for those
    domain = F.when(~other, let(read_label(label), lambda r: lasting_domain_of(kind_of_project(label, F.lit(""), r, none)["domain"])))
    file = F.when(other, filename_slug(label))
    return let(F.struct(read_label(label).alias("said"), F.coalesce(file, F.lit("")).alias("file"), F.coalesce(domain, F.lit("")).alias("domain")), keys)


def lasting_domain_of(domain: Column) -> Column:
    """The domain, unless it is one of those that are no projects."""
    return F.when(~domain.isin([n for n, _ in OTHER_DOMAINS]), domain)


def lasting_domain(label: Column, summary: Column) -> Column:
    """The domain of a project that lasts; null for none."""
    return lasting_domain_of(project_kind(label, summary)["domain"])


def family_label(kind: Column, label: Column, summary: Column) -> Column:
    """The family's label for traits of a person that belong to one, else the label."""
    text = F.concat_ws(" ", label, summary)
    out = None
    for name, one, other in FAMILY_RULES:
        cond = has_word(text, one) & has_word(text, other)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.when(kind.isin(SELF_MODEL), out.otherwise(label)).otherwise(label)


def keys_of(kind: Column, labels: Column, product: Callable[[Column], Column] | None = None) -> Column:
    """The keys of a label and its aliases (an array), a label's own keys together, in order. product: from a label, as in ``match_keys``."""
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: match_keys(kind, x, product(x) if product else None))))


def review_tokens(label: Column) -> Column:
    """The first eight significant tokens that say something about a review item."""
    stop = F.array(*map(F.lit, REVIEW_STOP_WORDS))
    return F.slice(F.filter(significant_tokens(label), lambda t: ~F.array_contains(stop, t)), 1, 8)


def guard_facts(kind: Column, label: Column, summary: Column) -> Column:
    """What ``may_merge`` reads of a label: the lasting domain of a project, the tokens and the file's name of another."""
    project = F.coalesce(kind == "project", F.lit(False))
    return F.struct(F.when(project, lasting_domain(label, summary)).alias("domain"), F.when(~project, significant_tokens(label)).alias("tokens"), F.when(~project, filename_slug(label)).alias("file"))


def may_merge(kind: Column, left: Column, right: Column, similarity: Column, threshold: float) -> Column:
    """Whether a similar label may be merged: projects of one lasting domain; else the very similar, or those that share a file's name or a token.
    left, right: ``guard_facts``."""
    file = (left["file"] != "") & (left["file"] == right["file"])
    return F.when(kind == "project", F.coalesce(left["domain"] == right["domain"], F.lit(False))).otherwise((similarity >= threshold + 0.05) | F.arrays_overlap(left["tokens"], right["tokens"]) | file)


def guarded(kind: Column, left: Column, right: Column, similarity: Column, threshold: float = 0.92, left_summary: Column | None = None, right_summary: Column | None = None) -> Column:
    """``may_merge`` of two labels, worked out row by row."""
    none = F.lit("")
    return may_merge(kind, *[guard_facts(kind, x, none if s is None else s) for x, s in ((left, left_summary), (right, right_summary))], similarity, threshold)


def named_stable(label: Column) -> Column:
    tokens = F.size(significant_tokens(label))
    marked = label.rlike(r"(?i)\.[a-z0-9]{1,8}$") | label.rlike(f"{B}[A-Z]{{2,}}{E}") | label.rlike("[a-z][A-Z]")
    proper = label.rlike("[0-9]") | trim_all(label).rlike("^[A-Z]")
    return (tokens > 0) & (F.length(label) <= 90) & (marked | (~narrow_action(label) & (proper | (tokens >= 3))))


def anchor_label(kind: Column, label: Column) -> Column:
    """Whether a label can stand for its source."""
    return named_stable(label) & ~narrow_action(label) & (name_strength(label) >= 1) & ((kind == "entity") | ~has_word(label, "note|topic|discussion|context|question"))


def durable_topic(label: Column) -> Column:
    return (F.size(significant_tokens(label)) >= 3) & (F.length(label) <= 80) & ~narrow_action(label)


def strongest(a: Column, b: Column, order: list[str]) -> Column:
    """The value that comes first in ``order``; unknown and null values come last."""
    rank = F.array(*map(F.lit, order))

    def place(x: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(rank, x), F.lit(0)), F.lit(99))

    return F.when(b.isNotNull() & (a.isNull() | (place(b) < place(a))), b).otherwise(a)


STABILITY = ["stable", "recurring", "situational", "temporary"]
INFERENCE = ["explicit", "supported_inference"]


def joined_text(left: Column, right: Column, most: int) -> Column:
    """Both texts, cut at ``most``; the left alone if it holds the right, the right as it is if there is no left."""
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    return F.when((right == "") | F.contains(left, right), left).when(left == "", right).otherwise(F.substring(F.concat(left, F.lit(" "), right), 1, most))


def merged_summary(left: Column, right: Column, most: int = 900) -> Column:
    """The longer of two texts of which one holds the other, else both, cut at ``most``."""
    return F.when((left != "") & (right != "") & F.contains(right, left), right).otherwise(joined_text(left, right, most))
