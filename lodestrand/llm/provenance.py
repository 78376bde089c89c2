"""Source files that nobody here wrote by hand: generated, minified, third-party or data stored as code.

A file's text is masked: comments apart, strings become S, numbers N and identifiers I, keywords and signs stay. RUN
consecutive masked tokens make a shingle. What a file repeats (shingles it holds REPEATS times or more) is its template, if
that covers COVER of it at least; templates are clustered by MinHash banding with exact verification, into families. A
family of two files or more decides on its members by what they hold on average:

- names of one or two letters on long lines: minified;
- literals and little else: data;
- anything else: the output of a generator, as people don't repeat themselves alike in several files.

Clusters of the five-word shingles of unmasked texts that span repositories are third-party copies.

A file may be the only one of its generator or the only copy here. Such a file is judged by its own text (the same averages,
of itself; runs of masked tokens that return; counters), by a statement of its origin and by its folder. A statement counts
only where a comment opens with it, so that code that merely talks about generated or vendored files stays hand-written.
Statements are looked for in the whole file, its foot too, but not inside a region that comments open and close (`begin x`
to `end x`): they speak of that region only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.words import BASE, distinct_by_text, mix, portions, shingle_hashes, word_hashes
from lodestrand.operators.components import components
from lodestrand.plans.scratch import Scratch
from lodestrand.sources.tables import instant

WIDTH, SIMILARITY = 5, 0.8
#: Masked tokens of a shingle, how often a file holds a shingle of its template, and how much of the file these cover.
RUN, REPEATS, COVER = 20, 3, 0.5
#: At a similarity of 0.8 two files share a bucket with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9994, at 0.3 with 0.003.
BANDS, ROWS = 40, 8
#: A file is data if literals hold this share of it, minified if this share of its names is at most two letters long on
#: lines of at least LONG characters on average, templated if fewer than FRESH of its runs of 32 masked tokens are new.
LITERAL, SHORT, LONG, FRESH = 0.65, 0.5, 160, 0.40
#: The files of a generator's family have fewer new runs than this on average.
FRESH_FAMILY = 0.45
#: Characters, names and runs that a file is taken to have besides its own, none of them telling: short texts say little.
SOLID, NAMES, RUNS = 60, 10, 16

# ---- fixed values: keywords kept by the mask, folders, and openings of comments that tell a file's origin
KEYWORDS = """abstract async await break case catch class const continue def default del do elif else enum except export extends final
finally fn for from func function if impl implements import in interface is lambda let loop match mod mut new None null package pass
private protected pub public raise return self static struct super switch this throw trait try type use var void while with yield""".split()
VENDOR_PATH = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|vendor|third[_-]?party|thirdparty|external|externals|extern|deps|Pods|Carthage|\.yarn)/")
GENERATED_PATH = re.compile(
    r"(?i)(?:^|/)(?:gen|generated|autogen|auto[_-]generated|__generated__|codegen[_-]out|generated[_-]sources?)/|(?:_pb2|_pb2_grpc|\.pb|\.pb\.gw|\.g|\.gen|\.generated|_generated|\.designer|\.freezed)\.[a-z]+$"
)
GENERATED = re.compile(
    r"""(?ix) ^ (?: (?:this|the)\s+(?:file|module|code|source|class)\s+(?:is|was|has\s+been)\s+)? (?:
      (?:code|file|source)\s+(?:auto-?)?generated\s+(?:by|from|with)\b | (?:auto-?|automatically\s+|machine[\s-]+|tool[\s-]+)(?:generated|produced|created|written|built)\b (?! \s+ (?:method|function|constructor|catch|getter|setter|block|member|stub) )
    | generated\s+(?:by|from|with|automatically)\b | @generated\b | <auto-?generated | autogenerated\b
    | (?:built|produced|created|compiled|emitted|rendered|written)\s+(?:by|from)\b .* (?:\bedit\b .* \binstead\b | \bdo\s+not\s+(?:edit|modify|change|touch)\b)
    | do\s+not\s+(?:edit|modify)\b .* \b(?:generated|produced\s+by|overwritten|regenerat\w+) ) """
)
GENERATED_ABROAD = re.compile(
    r"(?i)^(?:diese[srm]?\s+\w+\s+(?:wurde|ist|wird)\b.*\b(?:maschinell|automatisch)\b.*\b(?:erzeugt|generiert|erstellt)|(?:maschinell|automatisch)\s+(?:erzeugt|generiert|erstellt)|(?:este|esta)\s+\w+\s+(?:fue|ha\s+sido|se)\b.*\b(?:generad|autom[aá]tic)|generad[oa]\s+autom[aá]ticamente|(?:ce|cette)\s+\w+\s+(?:est|a\s+été)\b.*\bgénéré)"
)
VENDORED = re.compile(
    r"""(?ix) ^ (?: (?:this\s+is\s+)?(?:a\s+|an\s+)?(?:bundled|vendored|verbatim|local|embedded|unmodified|slightly\s+modified)\s+copy\s+of\b | (?:vendored|vendoring)\s+(?:from|copy)\b
    | (?:copied|taken|imported|adapted|synced|mirrored|forked|borrowed)\s+(?:verbatim\s+|unchanged\s+|unmodified\s+)?(?:from)\s+(?:the\s+)?(?:upstream|[\w.-]+\s+(?:project|library|package|repository)\b|https?:)
    | upstream\s*: | upstream\s+(?:source|version|commit|project)\b | origin\s+(?:commit|repository)\b | [\w.@/-]+\s+v\d[\w.]*\s*\|\s*(?:\(c\)|©|copyright|license) ) """
)
DENIED = re.compile(
    r"(?i)\b(?:used\s+to\s+be|formerly|no\s+longer|not\s+(?:auto-?)?generated|(?:maintained|edited|written|kept)\s+by\s+hand|hand-?(?:written|edited|maintained)|edited\s+freely|our\s+own|nowhere|once\s+(?:was\s+)?generated)\b"
)
# ----

_COMMENT = re.compile(r"(?://+!?|\#+!?|--|;+|/\*+!?|\*+|<!--|\"\"\"|''')\s*(?:-\*-\s*)?(.*?)\s*(?:\*/|-->|-\*-)?\s*$")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`")
_NUMBER = re.compile(r"(?<![\w.$])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)")
_NAME = re.compile(r"(?<![\w$])(?!(?:" + "|".join(KEYWORDS) + r")(?![\w$]))[A-Za-z_$][\w$]*")
_IMPORT = re.compile(r"\s*(?:import|from|use|package|require|include|#include|using)\b")
_BEGIN = re.compile(r"(?i)\W*begin\b(?:\s+of\b)?\W*(\w*)|\#?(region)\b")
_END = re.compile(r"(?i)\W*end\b(?:\s+of\b)?\W*(\w*)|\#?(?:end)(region)\b")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def _comments(lines: list[str]) -> list[str]:
    """The comments among the lines, without those inside a region that is opened and closed."""
    found = [m.group(1) for line in lines if (m := _COMMENT.match(line.strip()))]
    closed: dict[str, list[int]] = {}
    for i, c in enumerate(found):
        if m := _END.match(c):
            closed.setdefault((m.group(1) or m.group(2) or "").lower(), []).append(i)
    out, skip = [], -1
    for i, c in enumerate(found):
        if i > skip and closed and (m := _BEGIN.match(c)):
            skip = next((e for e in closed.get((m.group(1) or m.group(2) or "").lower(), ()) if e > i), skip)
        if i > skip:
            out.append(c)
    return out


def stated(lines: list[str], *patterns: re.Pattern) -> bool:
    """Whether a comment among the lines opens with one of the patterns and doesn't deny it."""
    return any(any(p.match(c) for p in patterns) and not DENIED.search(c) for c in _comments(lines))


def numbered(lines: list[str]) -> float:
    """Share of lines that carry a counter: lines alike but for names and numbers, one of whose numbers goes up by one."""
    last: dict[tuple[str, int], list[int]] = {}
    best = 0
    for line in lines:
        numbers = re.findall(r"\d+", line)
        if not numbers:
            continue
        form = re.sub(r"[A-Za-z_$]+", "I", re.sub(r"[0-9]+", "N", line.strip()))
        for place, n in enumerate(numbers):
            n = int(n) if len(n) < 4_000 else 0  # longer ones are no counters (and Python won't read them)
            held = last.setdefault((form, place), [n, 1])
            if n == held[0] + 1:
                held[0], held[1] = n, held[1] + 1
                best = max(best, held[1])
    return best / max(len(lines), 1) if best >= 8 else 0.0


class Facts:
    """What one file's text and path say by themselves."""

    def __init__(self, path: str, text: str):
        lines = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
        body = [x for x in lines if not _COMMENT.match(x.strip()) and not _IMPORT.match(x)]
        code = "\n".join(body)
        bare, _ = _STRING.subn("S", code)
        plain = _NUMBER.sub("N", bare)
        solid = len(re.sub(r"\s", "", code))
        kept = len(re.sub(r"[\sSN]|[,;:\[\]{}()+]", "", plain))
        names = [x for x in re.findall(r"[A-Za-z_$][\w$]*", plain) if x not in ("S", "N")]
        self.literal = (solid - kept) / (solid + SOLID)
        self.short = sum(len(x) <= 2 for x in names) / (len(names) + NAMES)
        self.width = sum(map(len, body)) / max(len(body), 1)
        tokens = _TOKEN.findall(_NAME.sub("I", plain))
        known: dict[str, int] = {}
        self.ids = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))
        self.vocabulary = _token_hashes(list(known))
        runs = self._runs(32)
        self.fresh = (len(np.unique(runs)) + RUNS) / (len(runs) + RUNS)
        self.numbered = numbered(lines)
        self.says_generated = stated(lines, GENERATED, GENERATED_ABROAD)
        self.says_vendored = stated(lines, VENDORED)
        self.generated_path = bool(GENERATED_PATH.search(path or ""))
        self.vendor_path = bool(VENDOR_PATH.search(path or ""))
        self.template, self.cover = self._template()

    def _runs(self, width: int) -> np.ndarray:
        """Hash of each run of so many masked tokens."""
        hashes = self.vocabulary[self.ids]
        run = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for i in range(width if len(run) else 0):
            run = run * np.uint64(BASE) + hashes[i : i + len(run)]
        return mix(run)

    def _template(self) -> tuple[np.ndarray, float]:
        """(distinct shingles of the template, share of the tokens in them); no shingles where they cover too little."""
        runs = self._runs(RUN)
        shingles, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
        often = counts >= REPEATS
        cover = float(often[back].sum()) / max(len(self.ids), 1) if len(runs) else 0.0
        return (shingles[often] if cover >= COVER else shingles[:0]), cover


def _token_hashes(tokens: list[str]) -> np.ndarray:
    values = np.zeros(len(tokens), np.uint64)
    for i, token in enumerate(tokens):
        b = np.frombuffer(token.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        values[i] = (np.multiply.accumulate(np.full(len(b), BASE, np.uint64)) * (b + np.uint64(1))).sum(dtype=np.uint64)
    return mix(values)


#: Odd multipliers: the shingles are mixed already, so a product modulo 2**64 is as good as another hash.
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """128 bits of a set of shingles."""
    return b"".join(mix(mix(shingles + np.uint64(s)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).tobytes() for s in (1, 2))


#: Two bits are kept of each of the BANDS * ROWS least hashes. Of two sets alike by SIMILARITY, 48 of the 320 differ on average, with
#: a standard deviation of 6.4, so pairs with more than this differing are below it but for one in 300,000.
DIFFERENT = 77


def bands(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS bucket keys of a set of shingles and the sketch of its least hashes, 32 in a number; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = np.array([(shingles * s).min() for s in _SEEDS], dtype=np.uint64)
    places = np.uint64(2) * np.arange(32, dtype=np.uint64)
    sketch = ((mix(least) >> np.uint64(62)).reshape(-1, 32) << places).sum(1, dtype=np.uint64)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(BASE) + least[:, r])
    return key, sketch


_FACTS = "doc_id string, project_id string, literal double, short double, width double, fresh double, numbered double, cover double, says_generated boolean, says_vendored boolean, generated_path boolean, vendor_path boolean, shingles array<long>, words array<long>, alike binary, same binary, bands array<long>, word_bands array<long>, sketch array<long>, word_sketch array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = [pa.string()] * 2 + [pa.float64()] * 6 + [pa.bool_()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 4
    for batch in batches:
        ids, projects, paths, texts = (batch.column(i).to_pylist() for i in range(4))
        for start, stop in portions(texts):
            words, to = distinct_by_text(*shingle_hashes(*word_hashes(texts[start:stop]), WIDTH))
            out = []
            for i in range(start, stop):
                facts = Facts(paths[i], texts[i] or "")
                shingles = facts.template
                own = words[to[i - start] : to[i - start + 1]]
                (keys, sketch), (word_keys, word_sketch) = bands(shingles), bands(own)
                out.append(
                    (
                        ids[i], projects[i], facts.literal, facts.short, facts.width, facts.fresh, facts.numbered, facts.cover, facts.says_generated, facts.says_vendored, facts.generated_path, facts.vendor_path,
                        shingles.view(np.int64), own.view(np.int64), signature(shingles), signature(own), *(x.view(np.int64) for x in (keys, word_keys, sketch, word_sketch)),
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def source_files(chunks: DataFrame) -> DataFrame:
    """doc_id, project_id, file_path, text of every source file: the current rows of its chunks joined in order.

    One shuffle by doc_id serves the choice of current rows (latest indexed_at of an id) and the joining. Files with
    language markdown or a markdown suffix are left out, as are null doc_ids.
    """
    rows = chunks.select("id", "doc_id", "project_id", "file_path", "language", "content", "chunk_index", "indexed_at").filter("doc_id <> ''")
    rows = rows.filter(~F.coalesce(F.lower(F.trim("language")) == "markdown", F.lit(False)) & ~F.coalesce(F.lower("file_path").rlike(r"\.(md|mdx|markdown)$"), F.lit(False)))
    rows = rows.repartition("doc_id")
    newest = Window.partitionBy("doc_id", "id").orderBy(instant("indexed_at").desc_nulls_last(), F.col("indexed_at").desc_nulls_last())
    rows = rows.withColumn("n", F.row_number().over(newest)).filter("n = 1")
    parts = F.sort_array(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "id", F.coalesce("content", F.lit("")).alias("content"))))
    return rows.groupBy("doc_id").agg(F.min("project_id").alias("project_id"), F.min("file_path").alias("file_path"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("text"))


#: Of a bucket whose files aren't all in one cluster yet, so many times more files than before are compared with all others.
FURTHER = 8


def _clusters(scratch: Scratch, facts: DataFrame, name: str, kind: str, sets: str, keys: str, sketches: str | None = None) -> DataFrame:
    """(kind, cluster): for every set of `sets`, known by its signature `kind`, the smallest doc_id of its cluster.

    Files with one set are one class from the start, led by their smallest doc_id, and only leaders are put into buckets.
    Files with an empty set are a class like any other. A bucket's first file is compared with all others, then, where the
    bucket still holds several clusters, the next FURTHER with those of other clusters, and so on: every pair that shares a
    bucket ends up in one cluster or compared, unless sizes or sketches rule it out, but never are all pairs of a bucket made at once.
    """
    classes = facts.groupBy(kind).agg(F.min("doc_id").alias("leader"))
    classes = scratch.write(classes, f"{name}-classes")
    leaders = classes.select(F.col("leader").alias("doc_id"))
    words = [f"g{i}" for i in range(BANDS * ROWS // 32)] if sketches else []
    buckets = facts.select("doc_id", F.size(sets).alias("size"), keys, *(F.col(sketches)[i].alias(g) for i, g in enumerate(words)))
    buckets = buckets.join(leaders, "doc_id", "left_semi").select("doc_id", "size", *words, F.explode(keys).alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    nth = F.row_number().over(Window.partitionBy("band").orderBy("doc_id"))
    buckets = scratch.write(buckets.join(shared, "band", "left_semi").withColumn("nth", nth), f"{name}-buckets")
    most = buckets.agg(F.max("nth")).first()[0] or 0
    held = facts.select("doc_id", F.col(sets).alias("s"))
    below, to, links = 0, 1, None
    found = buckets.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")).filter("false")
    open_ = buckets.withColumn("component", F.col("doc_id"))
    while below < most:
        firsts = open_.filter((F.col("nth") > below) & (F.col("nth") <= to)).select("band", F.col("doc_id").alias("first"), F.col("component").alias("other"), F.col("size").alias("fsize"), F.col("nth").alias("fnth"), *(F.col(g).alias(f"f{g}") for g in words))
        near = F.least("size", "fsize") >= SIMILARITY * F.greatest("size", "fsize")
        if words:
            differ = [F.col(w).bitwiseXOR(F.col(f"f{w}")) for w in words]
            differ = [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(0x5555555555555555)) for x in differ]
            near = near & (sum(differ[1:], differ[0]) <= DIFFERENT)
        pairs = open_.join(firsts, "band").filter((F.col("nth") > F.col("fnth")) & (F.col("component") != F.col("other")) & near)
        pairs = scratch.write(pairs.select("doc_id", "first").distinct(), f"{name}-pairs{to}")
        new = scratch.write(_verified(held, pairs), f"{name}-verified{to}")
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            found = components(links)
        below, to = to, to * FURTHER
        if below < most:
            placed = buckets.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            mixed = placed.groupBy("band").agg((F.min("component") < F.max("component")).alias("mixed"), F.max("nth").alias("n")).filter(F.col("mixed") & (F.col("n") > below)).select("band")
            open_ = scratch.write(placed.join(mixed, "band", "left_semi"), f"{name}-open{to}")
            most = open_.agg(F.max("nth")).first()[0] or 0
    return classes.join(found.select(F.col("node").alias("leader"), F.col("component").alias("cluster")), "leader", "left").select(kind, F.coalesce("cluster", "leader").alias("cluster"))


def _verified(held: DataFrame, links: DataFrame) -> DataFrame:
    """a, b: the links (doc_id, first) whose sets in held (doc_id, s) have a similarity of at least SIMILARITY."""
    ends = links.select(F.explode(F.array("doc_id", "first")).alias("doc_id")).distinct()
    held = held.join(ends, "doc_id", "left_semi")
    both = F.size(F.array_intersect("s", "fs"))
    verified = links.join(held, "doc_id").join(held.select(F.col("doc_id").alias("first"), F.col("s").alias("fs")), "first").filter(both >= SIMILARITY * (F.size("s") + F.size("fs") - both))
    return verified.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))


def provenance(files: DataFrame) -> DataFrame:
    """One row per file (doc_id, project_id, file_path, text): its facts, family, verdict and what that rests on.

    family names the smallest doc_id of the cluster of its template (itself where it has none), family_size, family_files and
    family_projects count the cluster's files, those in the file's project, and the projects; copy_projects counts projects
    that hold the same words (similarity of 0.8 or more). verdict is minified, data, generated, vendored or null for
    hand-written files; evidence is family, copies, text, statement or path, the first that holds. Null texts are empty texts; an empty or
    blank file is hand-written; null doc_ids drop out, and of rows with one doc_id any counts.
    """
    scratch = Scratch(files.sparkSession)
    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("project_id", F.lit("")).alias("project_id"), "file_path", "text").filter("doc_id is not null")
    facts = scratch.write(rows.dropDuplicates(["doc_id"]).mapInArrow(_describe, _FACTS), "facts")  # one row a doc_id before the wide columns are made

    family = _clusters(scratch, facts.filter(F.size("shingles") > 0), "family", "alike", "shingles", "bands", "sketch")
    copies = _clusters(scratch, facts.filter(F.size("words") > 0), "copies", "same", "words", "word_bands", "word_sketch")
    told = facts.drop("shingles", "words", "bands", "word_bands", "sketch", "word_sketch").join(family.withColumnRenamed("cluster", "family"), "alike", "left").join(copies.withColumnRenamed("cluster", "copy"), "same", "left").drop("alike", "same")
    told = scratch.write(told.withColumn("family", F.coalesce("family", "doc_id")).withColumn("copy", F.coalesce("copy", "doc_id")), "told")
    held = [(F.count("*"), "family_files"), *((F.sum(c), f"sum_{c}") for c in ("literal", "short", "width", "fresh"))]
    per_project = told.groupBy("family", "project_id").agg(*(value.alias(c) for value, c in held))
    spans = per_project.groupBy("family").agg(F.sum("family_files").alias("family_size"), F.count("*").alias("family_projects"), *((F.sum(f"sum_{c}") / F.sum("family_files")).alias(f"all_{c}") for c in ("literal", "short", "width", "fresh")))
    spread = told.groupBy("copy", "project_id").count().groupBy("copy").agg(F.count("*").alias("copy_projects"))
    told = told.join(per_project.select("family", "project_id", "family_files"), ["family", "project_id"]).join(spans, "family").join(spread, "copy")

    def kind(prefix: str):
        """minified or data by averages of a family, or a file's own."""
        literal, short, width = (F.col(f"{prefix}{c}") for c in ("literal", "short", "width"))
        return F.when((short >= SHORT) & (width >= LONG), "minified").when(literal >= LITERAL, "data")

    in_family = F.when(F.col("family_size") > 1, F.coalesce(kind("all_"), F.when(F.col("all_fresh") < FRESH_FAMILY, "generated")))
    copied = F.when(F.col("copy_projects") > 1, "vendored")
    templated = (F.col("fresh") < FRESH) | (F.col("numbered") >= 0.1)
    by_text = F.coalesce(kind(""), F.when(templated, "generated"))
    by_statement = F.when(F.col("says_generated"), "generated").when(F.col("says_vendored"), "vendored")
    by_path = F.when(F.col("generated_path"), "generated").when(F.col("vendor_path"), "vendored")
    ways = [(in_family, "family"), (copied, "copies"), (by_text, "text"), (by_statement, "statement"), (by_path, "path")]
    verdict = F.coalesce(*(way for way, _ in ways))
    evidence = F.coalesce(*(F.when(way.isNotNull(), said) for way, said in ways))
    return told.withColumn("verdict", verdict).withColumn("evidence", evidence).drop("copy", "all_literal", "all_short", "all_width", "all_fresh")
