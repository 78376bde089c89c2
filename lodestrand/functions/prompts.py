"""Functions on prompts, commands, metadata and priorities, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import first_case, keyword_similarity

# ---- fixed values: what prompts and commands are about, weights and tiers, words without a topic, first files
ENTITIES = [r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"[A-Z][A-Z_]{2,}", r"[a-z]+_[a-z_]+", r"[\"']([^\"']{2,})[\"']"]
FILE_PATH = r"[\w/.-]+\.\w{1,8}"
INTENTS = [
    ("DEBUG", r"(?i)(debug|error|fail|crash|exception|stack|trace|log|issue|problem|broken|wrong|unexpected|timeout|memory leak|performance)"),
    ("CODE", r"(?i)(implement|function|class|method|code|refactor|fix|bug|error|trace|debug|import|module|package|variable|parameter|return|exception|type|interface|constructor|inherit|override|abstract)"),
    ("ARCHITECTURAL", r"(?i)(architect|design|pattern|service|component|layer|module|depend|structure|flow|pipeline|system|integration|boundary|interface|api|microservice|monolith|coupling|cohesion)"),
]
URGENCY = r"(?i)(urgent|critical|blocking|asap|immediately|production|outage|down)"
RECALL = r"(?i)(why did we|remind me|last time|previously|earlier|before|what was|how did|remember when|we decided|the decision|the pattern|the approach|what about|recap|context|background)"
WEIGHTS = {"entity": 30, "filepath": 25, "intent": 20, "pivot": 15, "urgency": 10, "recall": 15}
TIERS = [(70, "FULL_PACKET"), (40, "RELATED_LINKS"), (20, "MEMORY_ONLY")]
PROMPT_STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can to of in for
on with at by from as into through during before after above below between and but or not no so if then than too very just about up out all
also how what when where why which who this that these those it its i me my we our you your he she they them their some any each every""".split()
COMMANDS = [
    ("test", r"(?i)(pytest|unittest|jest|mocha|cargo test|go test|mvn test|gradle test)"),
    ("build", r"(?i)(make|build|compile|cargo build|go build|mvn package|gradle build|npm run build|tsc)"),
    ("git", r"(?i)(git commit|git push|git merge|git rebase|git cherry-pick)"),
    ("deploy", r"(?i)(deploy|kubectl|docker push|helm|terraform apply)"),
]
FIRST_NAMES = [(2, ["pyproject.toml", "setup.py", "package.json", "cargo.toml", "go.mod"]), (3, ["main.py", "app.py", "index.py", "__main__.py", "cli.py"])]
FIRST_FOLDERS = [(4, ["api", "routes", "endpoints"]), (5, ["core", "src", "lib"])]
READMES = ["readme.md", "readme.rst", "readme.txt"]
METADATA_FIELDS = ["tags", "categories", "subject", "type", "domain"]
FOCUS = {"code": {"code": 0.7, "docs": 0.3}, "docs": {"code": 0.3, "docs": 0.7}, "balanced": {"code": 0.5, "docs": 0.5}}
# ----


def without_tags(prompt: Column) -> Column:
    """Prompt without tagged passages and empty tags."""
    return F.regexp_replace(F.regexp_replace(prompt, r"(?s)<[^>]+>.*?</[^>]+>", ""), r"<[^>]+/>", "")


def prompt_keywords(prompt: Column, most: int = 20) -> Column:
    """Distinct words among the first `most` of three letters or more that aren't stop words; tagged passages don't count."""
    words = F.regexp_extract_all(F.lower(without_tags(prompt)), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.array_distinct(F.slice(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(PROMPT_STOP_WORDS)), 1, most))


def prompt_signals(prompt: Column, pivot: Column | None = None) -> Column:
    """struct<score, tier, intent, entities, file_paths, has_urgency, has_recall> of a prompt; pivot: whether it leaves the topic of
    the one before. Entities and paths are distinct and sorted. A null prompt is an empty one."""
    clean = without_tags(F.coalesce(prompt, F.lit("")))
    camel, constant, snake = (F.regexp_extract_all(clean, F.lit(p), F.lit(0)) for p in ENTITIES[:3])
    quoted = F.regexp_extract_all(clean, F.lit(ENTITIES[3]), F.lit(1))
    entities = F.sort_array(F.array_distinct(F.concat(camel, constant, F.filter(snake, lambda s: F.length(s) > 4), quoted)))
    paths = F.sort_array(F.array_distinct(F.regexp_extract_all(clean, F.lit(FILE_PATH), F.lit(0))))
    intent = first_case([(clean.rlike(p), name) for name, p in INTENTS], "GENERAL")
    urgent, recall = clean.rlike(URGENCY), clean.rlike(RECALL)
    found = {"entity": F.size(entities) > 0, "filepath": F.size(paths) > 0, "intent": intent.isin("CODE", "ARCHITECTURAL"), "pivot": F.coalesce(pivot, F.lit(False)) if pivot is not None else F.lit(False), "urgency": urgent, "recall": recall}
    score = reduce(lambda a, b: a + b, (F.when(condition, WEIGHTS[name]).otherwise(0) for name, condition in found.items()))
    tier = first_case([(score >= least, name) for least, name in TIERS], "NONE")
    return F.struct(score.alias("score"), tier.alias("tier"), intent.alias("intent"), entities.alias("entities"), paths.alias("file_paths"), urgent.alias("has_urgency"), recall.alias("has_recall"))


def pivoted(words: Column, before: Column, least: float = 0.3) -> Column:
    """Whether a prompt's words leave the topic of the one before; not where either has none."""
    return before.isNotNull() & (F.size(before) > 0) & (F.size(words) > 0) & (keyword_similarity(words, before) < least)


def command_kind(command: Column) -> Column:
    return first_case([(command.rlike(p), k) for k, p in COMMANDS], "general")


def command_captured(command: Column, exit_code: Column) -> Column:
    """Whether a command is worth remembering: tests, commits and deployments always, builds where they failed."""
    kind = command_kind(command)
    return kind.isin("test", "git", "deploy") | ((kind == "build") & (F.coalesce(exit_code, F.lit(0)) != 0))


def command_outcome(exit_code: Column, output: Column) -> Column:
    """failed by exit code, else by what the output says, else passed."""
    return F.when(F.coalesce(exit_code, F.lit(0)) != 0, "failed").when(F.lower(output).rlike(r"\b(traceback|error:|failed|fatal:)"), "suspect").otherwise("passed")


def _top_folder(path: Column) -> Column:
    """First folder of a relative path, lower-cased; empty for a file at the top."""
    return F.lower(F.regexp_extract(path, "^([^/]*)/", 1))


def indexing_priority(path: Column) -> Column:
    """Order of indexing, smaller first: 1 readme, 2 build files, 3 entry points, 4 and 5 by the top folder, else 100."""
    name, top = F.lower(F.element_at(F.split(path, "/"), -1)), _top_folder(path)
    column = F.when(name.startswith("readme"), 1)
    for value, names in FIRST_NAMES:
        column = column.when(name.isin(names), value)
    for value, folders in FIRST_FOLDERS:
        column = column.when(top.isin(folders), value)
    return column.otherwise(100)


def fast_path(path: Column) -> Column:
    """Whether a file is indexed first: by its name, or by its top folder."""
    names = READMES + [n for _, names in FIRST_NAMES for n in names]
    return F.lower(F.element_at(F.split(path, "/"), -1)).isin(names) | _top_folder(path).isin([f for _, folders in FIRST_FOLDERS for f in folders])


def json_fields(metadata: Column, keys: list[str]) -> Column:
    """The given keys of a JSON object that it has, as a map of strings; empty for null or broken JSON."""
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object(metadata, f"$.{k}").alias("value")) for k in keys)), lambda p: p["value"].isNotNull())
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def metadata_score(metadata: Column, query: Column) -> Column:
    """Of the fields tags, categories, subject, type and domain that a JSON object has, the share whose value, or one of whose
    values, the query contains, case apart; 0 for null or broken JSON and where it has none of them."""
    low, keys = F.lower(query), F.json_object_keys(metadata)

    def hit(field: str) -> Column:
        value = F.get_json_object(metadata, f"$.{field}")
        values = F.when(value.startswith("["), F.from_json(value, "array<string>")).when(~value.startswith("{"), F.array(value))
        return F.coalesce(F.exists(values, lambda v: F.coalesce(F.contains(low, F.lower(v)), F.lit(False))), F.lit(False))

    total = reduce(lambda a, b: a + b, (F.coalesce(F.array_contains(keys, f), F.lit(False)).cast("int") for f in METADATA_FIELDS))
    hits = reduce(lambda a, b: a + b, (hit(f).cast("int") for f in METADATA_FIELDS))
    return F.when(total > 0, hits / total).otherwise(0.0)


def stalled(last: Column, started: Column, now: Column, seconds: float) -> Column:
    """Whether nothing has happened for so long."""
    return F.unix_micros(now) - F.unix_micros(F.coalesce(last, started)) > seconds * 1e6


def budget_shares(total: int, focus: str) -> dict[str, int]:
    """Tokens for code and docs by focus."""
    if focus not in FOCUS:
        raise ValueError(f"unknown focus: {focus!r}")
    return {part: int(total * weight) for part, weight in FOCUS[focus].items()}
