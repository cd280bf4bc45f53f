"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IDENT = "[^A-Za-z0-9_-]+"

def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c

def complexity(branches: Column | str, loops: Column | str) -> Column:
    """One path, plus one for each branch and loop."""
    return F.lit(1) + _c(branches) + _c(loops)

BANDS = ((1, 1), (2, 2), (3, 3), (5, 4), (7, 5), (10, 6), (15, 7), (20, 8), (30, 9))

def complexity_band(cx: Column | str) -> Column:
    """1..10; each band ends at the first number of ``BANDS``."""
    out = None
    for top, band in BANDS:
        hit = _c(cx) <= top
        out = F.when(hit, band) if out is None else out.when(hit, band)
    return out.otherwise(10)

def arity(params: Column | str) -> Column:
    p = _c(params)
    return F.when(p == 0, "niladic").when(p == 1, "monadic").when(p == 2, "dyadic").otherwise("variadic")

def one_line(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))

def truncate(s: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis where something was cut."""
    s = _c(s)
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 1)), F.lit("…"))).otherwise(s)

def strip_comment(s: Column | str) -> Column:
    """Comment text without its marks. As in the original, lines are joined by a space, so a block is one line."""
    bare = F.regexp_replace(_c(s), r"(?m)^\s*(?:/\*+!?|//[/!]?|#+!?|\*+/?|--|<!--|\"\"\"|''')", "")
    return one_line(F.regexp_replace(bare, r"(?m)(?:\*+/|-->|\"\"\"|''')\s*$", ""))

def is_shouting(s: Column | str) -> Column:
    return _c(s).rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$")

WRAPPERS = ("Option", "Result", "Vec", "Box", "Rc", "Arc", "RefCell", "Cell", "Mutex", "RwLock", "shared_ptr", "unique_ptr", "weak_ptr", "vector", "optional", "Promise", "Array", "ReadonlyArray", "Partial", "Readonly")


def normalize_type(raw: Column | str) -> Column:
    """The bare name of a declared type: no sigils, keywords or generics, wrappers with one argument unwrapped, up to eight times."""

    def step(s: Column) -> Column:
        s = F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[:&*( ]+", ""), r"[;?), ]+$", ""))
        for kw in ("mut", "const", "readonly", "dyn", "impl", "static", "final"):
            s = F.trim(F.regexp_replace(s, f"^{kw} ", ""))
        s = F.trim(F.regexp_replace(s, r"(?:\[\])+$", ""))
        s = F.trim(F.regexp_replace(s, r"^\[\]", ""))
        head = F.regexp_extract(s, r"^([^<]*)<", 1)
        inner = F.regexp_replace(F.regexp_extract(s, r"(?s)^[^<]*<(.*)$", 1), ">$", "")
        args = F.filter(F.transform(F.split(inner, ","), F.trim), lambda a: (a != "") & ~a.startswith("'"))
        first = F.when(F.size(args) > 0, F.element_at(args, 1)).otherwise(inner)
        return F.when(F.trim(F.regexp_replace(head, "^.*::", "")).isin(*WRAPPERS), first).otherwise(s)

    s = F.aggregate(F.array_repeat(F.lit(0), 8), F.trim(_c(raw)), lambda acc, _: step(acc))
    s = F.regexp_replace(s, r"(?s)<.*$", "")
    for sep in ("::", r"\.", "->"):
        s = F.regexp_replace(s, f"(?s)^.*{sep}", "")
    return F.trim(s)


def segments(path: Column | str) -> Column:
    """The identifiers of a module path or qualifier."""
    return F.filter(F.split(_c(path), IDENT), lambda x: x != "")

def split_qualified(s: Column | str) -> Column:
    """struct(qualifier, name), cut at the last ``::`` or ``.``; qualifier null where there is none."""
    s = _c(s)
    q = F.regexp_extract(s, r"^(.*)(?:::|\.)[^:.]*$", 1)
    name = F.regexp_extract(s, r"([^:.]*)$", 1)
    return F.struct(F.when(q != "", q).alias("qualifier"), F.when(q != "", name).otherwise(s).alias("name"))

def split_query(s: Column | str) -> Column:
    """struct(qualifier, name, under): a query that ends in a separator asks for all under the qualifier."""
    s = _c(s)
    open_ = s.rlike(r"(?:::|\.)$")
    bare = F.regexp_replace(s, r"(?:::|\.)$", "")
    q = split_qualified(s)
    return F.when(open_, F.struct(bare.alias("qualifier"), F.lit("").alias("name"), F.lit(True).alias("under"))).otherwise(F.struct(q["qualifier"].alias("qualifier"), q["name"].alias("name"), F.lit(False).alias("under")))

def edit_distance(a: Column | str, b: Column | str, most: int) -> Column:
    """Levenshtein distance, null beyond ``most``."""
    d = F.levenshtein(_c(a), _c(b), most)
    return F.when(d >= 0, d)

def name_distance(query: Column | str, name: Column | str) -> Column:
    """0 if equal but for case; 1000 and on if one holds the other; 2000 and on by edits, up to a third of the length (2 at least); else null."""
    q, n = F.lower(_c(query)), F.lower(_c(name))
    cap = F.greatest(F.lit(2), F.floor(F.length(q) / 3).cast("int"))
    d = F.levenshtein(q, n)
    return F.when(q == n, 0).when(F.contains(n, q) | F.contains(q, n), 1000 + F.least(F.abs(F.length(q) - F.length(n)), F.lit(999))).when(d <= cap, 2000 + d)

def short_hash(s: Column | str) -> Column:
    """The low half of the 64-bit FNV-1a hash as eight hex digits; only the low half of the state decides it, so 64-bit arithmetic is enough."""

    def step(h: Column, code: Column) -> Column:
        # only the low 40 bits of the prime and 32 of the state decide the low 32 bits of the product
        x = h.bitwiseXOR(code)
        return (x * F.lit(0x1B3)).bitwiseAND(F.lit(0xFFFFFFFF))

    data = F.encode(_c(s), "UTF-8")
    hexed = F.hex(data)
    codes = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(hexed) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(0x84222325).cast("long"), step)), 8, "0"))

def sanitize(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), r"[^A-Za-z0-9._]", "_")

def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)

def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)

def stem(path: Column | str) -> Column:
    """File name without its last extension; a name that only starts with a dot is its own stem."""
    n = file_name(path)
    return F.coalesce(F.nullif(F.regexp_extract(n, r"^(.+)\.[^.]*$", 1), F.lit("")), n)

def extension(path: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1), F.lit("")), F.lit("txt"))


def cache_base(path: Column | str) -> Column:
    """Directories and stem joined by hyphens."""
    dirs = F.filter(F.split(parent_dir(path), "/"), lambda x: x != "")
    return F.array_join(F.transform(F.concat(dirs, F.array(stem(path))), sanitize), "-")


def cache_name(path: Column | str) -> Column:
    return F.concat(cache_base(path), F.lit("."), sanitize(extension(path)), F.lit(".md"))


def disambiguated_cache_name(path: Column | str) -> Column:
    return F.concat(cache_base(path), F.lit("-"), short_hash(path), F.lit("."), sanitize(extension(path)), F.lit(".md"))


def display_name(path: Column | str) -> Column:
    return F.concat(stem(path), F.lit("."), extension(path), F.lit(".md"))


def strip_stamp(line: Column | str) -> Column:
    """A line without its UTC stamp, for comparisons."""
    return F.regexp_replace(_c(line), r"\d{8}-\d{2}-\d{2}-\d{2}", "")

def utc_stamp(ts: Column | None = None) -> Column:
    """A time as ``20240131-23-59-59`` in UTC, whatever the session's time zone."""
    ts = ts if ts is not None else F.current_timestamp()
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyyMMdd-HH-mm-ss")

def norm_key(k: Column | str) -> Column:
    return F.lower(F.trim(_c(k)))

def pick_transport(a: Column | str, b: Column | str) -> Column:
    return F.when(_c(a) != "unspecified", _c(a)).otherwise(_c(b))

VIA = {"annotation": 0, "receiver-type": 1, "qualifier": 2, "project": 3, "import": 4, "type-reference": 5, "name-only": 6}
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed"}

def _lookup(c: Column | str, of: dict, other: object) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(_c(c) == k, v) if out is None else out.when(_c(c) == k, v)
    return out.otherwise(other)

def via_rank(via: Column | str) -> Column:
    return _lookup(via, VIA, 6)

def status_label(code: Column | str) -> Column:
    return _lookup(F.substring(_c(code), 1, 1), STATUS, "changed")

def toml_version(line: Column | str) -> Column:
    """The version of a dependency line, plain or in an inline table; null where there is none."""
    line = _c(line)
    plain = F.regexp_extract(line, r"^[^=]+=\s*\"([^\"]*)\"", 1)
    table = F.regexp_extract(line, r"version\s*=\s*\"([^\"]*)\"", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(table, F.lit("")))

def url_decode(s: Column | str) -> Column:
    return F.try_url_decode(_c(s))

def query_params(url: Column | str) -> Column:
    """Map of the parameters of a url; of a repeated one the last."""
    q = F.regexp_extract(_c(url), r"\?([^#]*)", 1)
    parts = F.filter(F.split(q, "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(url_decode(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), url_decode(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")))
    last = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(last)

def target_id(file: Column | str, function: Column | str) -> Column:
    return F.concat_ws("::", _c(file), _c(function))

def facade_name(path: Column | str, project: Column | str | None = None) -> Column:
    """What a facade is imported as: ``__init__`` and ``mod`` by their directory, ``lib`` by the name of the project; other files by their stem."""
    s, d = stem(path), F.nullif(F.element_at(F.split(parent_dir(path), "/"), -1), F.lit(""))
    own = F.lit(None).cast("string") if project is None else _c(project)
    return F.when(s.isin("__init__", "mod"), d).when(s == "lib", own).otherwise(s)
