"""What git says has changed, and what manifests declare, as tables. Texts come in as rows; nothing here runs git."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import _c, status_label, toml_version


def hunks(diff: Column | str) -> Column:
    """Array of ``path, start, stop`` of a unified diff: lines on the new side; a deletion marks the line it was at.

    Deleted files have none. Folding over the lines keeps the file they belong to.
    """
    lines = F.split(_c(diff), r"\r?\n")
    zero = F.struct(F.lit(None).cast("string").alias("path"), F.array().cast("array<struct<path:string,start:bigint,stop:bigint>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(F.rtrim(F.substring(line, F.lit(5), F.length(line))), '^"|"$', ""), "^b/", "")
        start = F.regexp_extract(line, r"^@@[^+]*\+(\d+)", 1).cast("long")
        many = F.coalesce(F.nullif(F.regexp_extract(line, r"^@@[^+]*\+\d+,(\d+)", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
        low = F.when(many == 0, F.greatest(start, F.lit(1).cast("long"))).otherwise(start)
        high = F.when(many == 0, low).otherwise(start + many - 1)
        to = F.when(name == "/dev/null", F.lit(None).cast("string")).otherwise(name)
        add = F.concat(acc["out"], F.array(F.struct(acc["path"].alias("path"), low.alias("start"), high.alias("stop"))))
        hunk = line.rlike(r"^@@[^+]*\+\d+") & acc["path"].isNotNull()
        return F.struct(F.when(line.startswith("+++ "), to).otherwise(acc["path"]).alias("path"), F.when(hunk, add).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, zero, step)["out"]


def read_hunks(diffs: DataFrame, col: str = "diff") -> DataFrame:
    """``path, start, stop`` of every diff in a table."""
    return diffs.select(F.inline(hunks(col)))


def name_status(raw: Column | str) -> Column:
    """Array of ``status, path`` of NUL-separated status output; a rename is the new path renamed and the old one deleted."""
    words = F.filter(F.split(_c(raw), "\0"), lambda x: x != "")
    kind = "array<struct<status:string,path:string>>"
    zero = F.struct(F.lit("").alias("code"), F.lit(None).cast("string").alias("old"), F.array().cast(kind).alias("out"))
    row = lambda s, p: F.struct(s.alias("status"), p.alias("path"))

    def step(acc: Column, w: Column) -> Column:
        code, old = acc["code"], acc["old"]
        two = code.isin("R", "C")
        done = F.when(two & (code == "R"), F.array(row(status_label(code), w), row(F.lit("deleted"), old))).otherwise(F.array(row(status_label(code), w)))
        ready = (code != "") & (~two | old.isNotNull())
        return F.struct(
            F.when(code == "", F.substring(w, 1, 1)).when(ready, "").otherwise(code).alias("code"),
            F.when((code != "") & two & old.isNull(), w).otherwise(F.lit(None).cast("string")).alias("old"),
            F.when(ready, F.concat(acc["out"], done)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(words, zero, step)["out"]


def declared_packages(manifests: DataFrame) -> DataFrame:
    """``manifest, kind, name, version``: dependencies that manifests (``path, text``) declare.

    Cargo.toml, package.json, go.mod and requirements.txt are read line by line or entry by entry; other
    files give nothing.
    """
    m = manifests.select(F.element_at(F.split("path", "/"), -1).alias("manifest"), "text")
    lines = m.select("manifest", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    c = F.col
    # toml: the section of a line is that of the last header above it, found by a fold in the row
    sect = F.aggregate(
        F.split("text", r"\r?\n"),
        F.struct(F.lit("").alias("s"), F.array().cast("array<struct<s:string,line:string>>").alias("out")),
        lambda a, x: F.struct(F.when(x.rlike(r"^\s*\[.*\]\s*(#.*)?$"), F.trim(F.regexp_extract(x, r"^\s*\[+([^\]]*)\]", 1))).otherwise(a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(F.when(x.rlike(r"^\s*\[.*\]\s*(#.*)?$"), F.trim(F.regexp_extract(x, r"^\s*\[+([^\]]*)\]", 1))).otherwise(a["s"]).alias("s"), F.trim(F.regexp_replace(x, "#.*$", "")).alias("line")))).alias("out")),
    )["out"]
    toml = m.where("manifest = 'Cargo.toml'").select("manifest", F.inline(sect))
    kinds = ("dependencies", "dev-dependencies", "build-dependencies")
    last = F.element_at(F.split("s", r"\."), -1)
    plain = toml.where(last.isin(*kinds) & c("line").contains("=")).select("manifest", last.alias("kind"), F.trim(F.translate(F.split_part("line", F.lit("="), F.lit(1)), '"', "")).alias("name"), toml_version("line").alias("version"))
    table = toml.where(c("line").startswith("[") & c("s").rlike(rf"^({'|'.join(kinds)})\.[^.]+$")).select("manifest", F.split_part("s", F.lit("."), F.lit(1)).alias("kind"), F.translate(F.split_part("s", F.lit("."), F.lit(2)), '"', "").alias("name"), F.lit(None).cast("string").alias("version"))
    js = m.where("manifest = 'package.json'").select("manifest", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>").alias("d")) for k in ("dependencies", "devDependencies")])).alias("x")).select("manifest", "x.kind", F.explode("x.d").alias("name", "version"))
    go = lines.where("manifest = 'go.mod'").withColumn("t", F.regexp_replace(F.regexp_replace("line", "//.*$", ""), r"^\s+|\s+$", ""))
    go = go.select("manifest", F.lit("require").alias("kind"), F.regexp_extract("t", r"^(?:require\s+)?([^\s()]+\.[^\s()]*/?[^\s()]*)\s+(v\S+)$", 1).alias("name"), F.regexp_extract("t", r"\s(v\S+)$", 1).alias("version")).where("name <> ''")
    req = lines.where("manifest = 'requirements.txt'").withColumn("t", F.trim(F.regexp_replace("line", "#.*$", ""))).where("t <> '' and not t like '-%'")
    req = req.select("manifest", F.lit("requirement").alias("kind"), F.regexp_extract("t", r"^([^=<>!~\[ ;]+)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace("t", r"^[^=<>!~\[ ;]+", "")), F.lit("")).alias("version")).where("name <> ''")
    out = plain
    for x in (table, js, go, req):
        out = out.unionByName(x)
    return out


def package_named(packages: DataFrame, name: str) -> DataFrame:
    """Declared packages of a name, whatever its case, hyphens as underscores."""
    return packages.where(F.lower(F.translate("name", "-", "_")) == name.lower().replace("-", "_"))
