"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong spans are found by pattern. Weak candidates (short access identifiers, user names, short or
unlabelled secrets, endpoints) say little alone; they are reported only where a complementary
part lies within reach in the same text: identifiers with secrets, secrets with identifiers or
endpoints, endpoints with secrets. What counts is the gap between the two, from the end of one to
the start of the other. That is an interval join: a part falls into all bins of the reach that it
touches, so a complementary part within reach touches a bin that the candidate, longer by the reach
on both sides, touches too. For each (text, bin, role) only the least start and the greatest end are
needed, which sums up any number of parts in one row before the join; no pairs are formed.

Places are in code points, ends exclusive. A kind's spans are leftmost and don't overlap. Nulls: a
null text is an empty one. Equal rows give equal results. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import atomic, own_names, Tables

#: The strong kinds, their patterns, and the least length of a group.
STRONG = {
    "assign": ("""(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: pattern, group whose length counts, least length, role.
_HEAD, _TAIL = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Before a name there may be a prefix that ends with a sign, as in DB_USER.
_NAME = "(?<![A-Za-z0-9])"
_SET = """["']?\\x20*[:=]\\x20*["']?"""
WEAK = {
    "weak_id": (f"{_HEAD}AKIA[A-Z0-9]{{8,15}}{_TAIL}|{_NAME}(?i:user(?:name)?|login|account|client_?id|access_?key_?id){_SET}[A-Za-z0-9_.@-]{{3,}}", 0, 3, "id"),
    "weak_secret": (f"{_NAME}(?i:pwd|pass|passphrase|auth|credential|private_?key|secret_?key){_SET}[A-Za-z0-9+/_.=-]{{6,}}|{_HEAD}[0-9a-f]{{16,23}}{_TAIL}|(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{{40}}(?![A-Za-z0-9+/=]))(?=[A-Za-z0-9+/]{{0,39}}[0-9])(?=[A-Za-z0-9+/]{{0,39}}[A-Z])(?=[A-Za-z0-9+/]{{0,39}}[a-z])[A-Za-z0-9+/]{{40}}", 0, 6, "secret"),
    "endpoint": (f"""{_HEAD}[a-z][a-z0-9+.-]{{1,15}}://[^\\x20\\x09-\\x0D"'<>]{{3,}}|{_NAME}(?i:host|endpoint|server){_SET}[A-Za-z0-9_.:-]{{3,}}""", 0, 3, "endpoint"),
}
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {k: v[3] for k, v in WEAK.items()}
KINDS = [*STRONG, *WEAK]
#: For each role, the roles that complement it.
COMPLEMENT = {"id": ["secret"], "secret": ["id", "endpoint"], "endpoint": ["secret"]}
#: A run so long that it may be a key; it is looked for from the run's start only.
LONG_RUN = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16}"
REACH = 200
#: Spans that a fold holds in one growing list, and code points of a piece that a text is cut into.
CHUNK, PIECE = 256, 1024
#: Rows of equal texts are joined to the text's links in so many tasks.
SALTS = 16
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def folded(items: Column, start: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Everything that a fold over an array puts out, without copying all that came before at each step.

    step takes (state `at`, list `out`) and an item and gives both anew. Items go in chunks: a list grows
    within its chunk only, and the chunks' lists are joined once.
    """
    none = F.array().cast(kind)

    def chunk(a: Column, c: Column) -> Column:
        return F.aggregate(c, F.struct(a["at"].alias("at"), none.alias("out")), step, lambda r: F.struct(r["at"].alias("at"), F.concat(a["lists"], F.array(r["out"])).alias("lists")))

    def over(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda k: F.slice(every, k * CHUNK + 1, F.lit(CHUNK)))
        every_list = F.aggregate(chunks, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("lists")), chunk, lambda a: F.flatten(a["lists"]))
        return F.when(F.size(every) > 0, every_list).otherwise(none)

    return let(items, over)


def hinted(text: Column, lower: Column, long: Column, kind: str) -> Column:
    """Whether a text may have a kind's spans: plain searches that most texts fail, before any pattern runs."""
    names = lambda *words: reduce(or_, (lower.contains(w) for w in words))
    sign = lower.contains("=") | lower.contains(":")
    return {
        "assign": sign & names("passw", "secret", "token", "apikey", "api_key"),
        "access": text.contains("AKIA"),
        "hex": long,
        "weak_id": text.contains("AKIA") | sign & names("user", "login", "account", "client", "access"),
        "weak_secret": long | sign & names("pwd", "pass", "auth", "credential", "key"),
        "endpoint": text.contains("://") | sign & names("host", "endpoint", "server"),
    }[kind]


def spans_of(text: Column, hint: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """All spans of a pattern: what lies between matches is a split's pieces, so places are sums of lengths."""
    full = F.lit(f"({pattern})")
    lengths = F.transform(F.regexp_extract_all(text, full, F.lit(0)), F.char_length)
    gaps = F.transform(F.split(text, f"({pattern})", -1), F.char_length)
    value = F.transform(F.regexp_extract_all(text, full, F.lit(group + 1)), F.char_length) if group else lengths

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.coalesce(x["gap"], F.lit(0))
        end = start + F.coalesce(x["length"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    every = folded(F.arrays_zip(gaps.alias("gap"), lengths.alias("length"), value.alias("value")), F.lit(0), SPAN, step)
    return F.when(hint & text.rlike(pattern), every).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def found_in(df: DataFrame, text_col: str) -> DataFrame:
    """df with the spans of all kinds of its texts, each in a column of two underscores and the kind's name."""
    rows = df.withColumn("__plain", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns({"__lower": F.lower("__plain"), "__long": F.col("__plain").rlike(LONG_RUN)})
    text, lower, long = F.col("__plain"), F.col("__lower"), F.col("__long")
    return rows.withColumns({f"__{k}": spans_of(text, hinted(text, lower, long, k), k, *v[:3]) for k, v in (STRONG | WEAK).items()})


def candidates(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep (renamed by place), __key of the text, strong and weak spans of each row."""
    rows = found_in(df.select(*(F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)), F.col(text_col).alias("__text")), "__text")
    weak = F.concat(*(F.col(f"__{k}") for k in WEAK))
    return rows.select(*(f"__keep{k}" for k in range(len(keep))), *(f"__{k}" for k in STRONG), weak.alias("__weak"), F.sha2(F.encode("__plain", "UTF-8"), 256).alias("__key"))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, spans): the weak candidates that have a complementary part within reach, of (key, weak, strong) rows.

    Two parts are within reach if they overlap or no more than so many code points lie between the
    end of one and the start of the other. A candidate that overlaps a strong span isn't reported, as that is already.
    """
    role = F.element_at(F.create_map(*(x for k, r in ROLE.items() for x in (F.lit(k), F.lit(r)))), F.col("p.kind"))
    # Equal texts need linking once. Only texts with a weak candidate and two parts can have a link.
    able = parts.where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1)).groupBy("key").agg(F.first("weak").alias("weak"), F.first("strong").alias("strong"))
    bins = lambda start, end: F.sequence(F.floor(start / reach), F.floor(end / reach))
    start, end = F.col("p.start"), F.col("p.end")
    every = able.select("key", F.explode(F.concat("weak", "strong")).alias("p")).select("key", "p", role.alias("role"))
    summed = every.select("key", "p", "role", F.explode(bins(start, end)).alias("bin")).groupBy("key", "bin", "role").agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    weak = every.where(F.col("p.kind").isin(list(WEAK)))
    wants = F.element_at(F.create_map(*(x for r, c in COMPLEMENT.items() for x in (F.lit(r), F.array(*map(F.lit, c))))), F.col("role"))
    probes = weak.select("key", "p", F.explode(wants).alias("role")).withColumn("bin", F.explode(bins(start - reach, end + reach)))
    # Parts that touch one bin leave no room between them for a candidate out of reach of all, so the two bounds may be of different parts.
    near = (F.col("lo") <= end + reach) & (F.col("hi") >= start - reach)
    hits = probes.join(summed, ["key", "bin", "role"]).where(near)
    return hits.groupBy("key").agg(F.collect_set("p").alias("spans"))


def with_links(found: DataFrame, links: DataFrame, key: str, weak: str, spread: list[str]) -> DataFrame:
    """found with `__linked`, its text's linked spans or null, from (key, spans) rows, one for each text.

    Rows without a weak candidate have none, so they aren't joined or shuffled. The others, of which
    many may share a text, are salted by a hash of the columns `spread`.
    """
    none = found.where(F.size(weak) == 0).withColumn("__linked", F.lit(None).cast(SPAN))
    some = found.where(F.size(weak) > 0).withColumn("__salt", F.pmod(F.xxhash64(F.lit(0), *spread), F.lit(SALTS)).cast("int"))
    each = links.select(F.col("key").alias("__of"), F.col("spans").alias("__linked"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__at"))
    joined = some.join(each, (F.col(key) == F.col("__of")) & (F.col("__salt") == F.col("__at")), "left")
    return joined.select(*found.columns, "__linked").unionByName(none)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), reach: int = REACH) -> DataFrame:
    """(id, *keep, assign, access, hex, linked): arrays of spans (start, rank, kind, end) of each row's whole text.

    What is kept may have any names; they come first, in their order.
    """
    head = [id_col, *keep]
    found = Tables(df.sparkSession, "secrets").keep(candidates(df, text_col, head), "spans")
    strong = F.concat(*(F.col(f"__{k}") for k in STRONG))
    links = linked(found.select(F.col("__key").alias("key"), F.col("__weak").alias("weak"), strong.alias("strong")), reach)
    own = [f"__keep{k}" for k in range(len(head))]
    joined = with_links(found, links, "__key", "__weak", atomic(found, own))
    # A candidate within a strong span is already reported.
    weak = uncovered(F.coalesce("__linked", F.array().cast(SPAN)), strong)
    return joined.select(*(F.col(o).alias(c) for o, c in zip(own, head, strict=True)), *(F.col(f"__{k}").alias(k) for k in STRONG), weak.alias("linked"))


def uncovered(weak: Column, strong: Column) -> Column:
    """The weak spans that overlap no strong one, by two folds over all in order: strong ones before, then behind."""
    is_weak = lambda x: x["rank"] >= len(STRONG)

    def fold(spans: Column, order: Callable[[Column], Column], start: int, free, bound) -> Column:
        def step(a: Column, x: Column) -> Column:
            return F.struct(F.when(is_weak(x), a["at"]).otherwise(bound(a["at"], x)).alias("at"), F.when(is_weak(x) & free(a["at"], x), F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

        return folded(order(F.array_sort(F.concat(strong, spans))), F.lit(start), SPAN, step)

    ahead = fold(weak, lambda x: x, 0, lambda at, x: x["start"] >= at, lambda at, x: F.greatest(at, x["end"]))
    both = fold(ahead, F.reverse, 2**31 - 1, lambda at, x: x["end"] <= at, lambda at, x: x["start"])
    return F.when((F.size(weak) > 0) & (F.size(strong) > 0), both).otherwise(weak)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.concat(*STRONG)
    return scanned.select(F.col(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in STRONG), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.concat(base, "linked")).alias("spans"))


def without(text: Column, cuts: Column, mark: str) -> Column:
    """A text with each run of overlapping cuts replaced by a mark.

    What stays is put together from pieces of bounded length, so a place far into a text costs no more than one near its start.
    """
    kept = lambda every: folded(every, F.lit(0), "array<struct<a:int,b:int>>", lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], F.array(F.struct(a["at"].alias("a"), x["start"].alias("b"))))).otherwise(a["out"]).alias("out")))

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        return F.when(b > a, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), a % PIECE + 1, b - a)).otherwise("")

    def whole(pieces: Column) -> Column:
        end = F.array_max(F.transform(cuts, lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(kept(cuts), lambda k: F.concat(part(pieces, k["a"], k["b"]), F.lit(mark))), ""), part(pieces, end, F.char_length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), whole)


def redacted(df: DataFrame, mark: str, text_col: str = "text", count_col: str = "n_chars", reach: int = REACH) -> DataFrame:
    """df's rows and columns with each secret and identifier found replaced by a mark; overlapping spans by one.

    Endpoints stay. Where a text changes, count_col, if there, gets its new number of code points.
    A null text stays null. Columns may have any names. The texts and their spans are written once, and stay in the shared folder.
    """
    tables = Tables(df.sparkSession, "redaction")
    docs, own = own_names(df)
    at = own[text_col]
    found = found_in(docs, at)
    weak = F.concat(*(F.col(f"__{k}") for k in WEAK))
    # Texts without a weak candidate need no key: they aren't joined to anything.
    key = F.when(F.size(weak) > 0, F.sha2(F.encode("__plain", "UTF-8"), 256))
    found = tables.keep(found.select(*own.values(), F.concat(*(F.col(f"__{k}") for k in STRONG)).alias("__strong"), weak.alias("__weak"), key.alias("__key")), "spans")
    links = linked(found.where("__key is not null").select(F.col("__key").alias("key"), F.col("__weak").alias("weak"), F.col("__strong").alias("strong")), reach)
    joined = with_links(found, links, "__key", "__weak", atomic(docs, list(own.values())))
    wanted = F.filter(F.coalesce("__linked", F.array().cast(SPAN)), lambda x: x["kind"] != "endpoint")
    text = F.col(at).cast("string")
    out = joined.withColumn("__cuts", F.array_sort(F.concat("__strong", wanted)))
    out = out.withColumn("__new", F.when(F.size("__cuts") > 0, without(text, F.col("__cuts"), mark)).otherwise(text))
    columns = []
    for c, o in own.items():
        if c == text_col:
            columns.append(F.col("__new").alias(c))
        elif c == count_col:
            columns.append(F.when(F.size("__cuts") > 0, F.char_length("__new")).otherwise(F.col(o)).cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(o).alias(c))
    return out.select(*columns)
