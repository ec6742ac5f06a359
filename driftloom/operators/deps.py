"""Dependency entries against lockfiles: vouching, renames, nearest lockfiles, and the severities that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity and label of an ecosystem's findings by rule.
FINDINGS = {
    "npm": {
        "dep-not-in-lockfile": ("high", "Dependency not in lockfile"),
        "dep-added": ("medium", "New dependency"),
        "dep-changed": ("low", "Dependency version changed"),
        "script-changed": ("medium", "npm script changed"),
    },
    "cargo": {
        "dep-not-in-lockfile": ("high", "Dependency not in lockfile"),
        "dep-added": ("medium", "New dependency"),
        "dep-added-local": ("low", "Local dependency added"),
        "dep-added-nolock": ("low", "Dependency"),
        "dep-changed": ("low", "Dependency version changed"),
        "cargo-build-script": ("medium", "Build script changed"),
    },
    "go": {
        "dep-not-in-lockfile": ("high", "Dependency not in lockfile"),
        "dep-added": ("medium", "New dependency"),
        "dep-added-indirect": ("low", "Indirect dependency added"),
        "dep-added-local": ("low", "New dependency"),
        "dep-added-nolock": ("low", "New dependency"),
        "dep-changed": ("low", "Dependency version changed"),
    },
    "requirements": {"dep-added-nolock": ("low", "New dependency"), "dep-changed": ("low", "Dependency version changed")},
    "pyproject": {
        "dep-not-in-lockfile": ("high", "Dependency not in lockfile"),
        "dep-added": ("medium", "New dependency"),
        "dep-added-local": ("low", "New dependency"),
        "dep-added-nolock": ("low", "New dependency"),
        "dep-changed": ("low", "Dependency version changed"),
    },
    "maven": {"dep-added-nolock": ("low", "New dependency"), "dep-changed": ("low", "Dependency version changed")},
    "nuget": {
        "dep-not-in-lockfile": ("high", "Dependency not in lockfile"),
        "dep-added": ("medium", "New dependency"),
        "dep-added-local": ("low", "New dependency"),
        "dep-added-nolock": ("low", "New dependency"),
        "dep-changed": ("low", "Dependency version changed"),
    },
}
# Manifests by file name, their ecosystem and the lockfile beside them.
MANIFESTS = {
    "package.json": ("npm", ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")),
    "Cargo.toml": ("cargo", ("Cargo.lock",)),
    "go.mod": ("go", ("go.sum",)),
    "requirements.txt": ("requirements", ()),
    "pyproject.toml": ("pyproject", ("poetry.lock",)),
    "pom.xml": ("maven", ()),
    "*.csproj": ("nuget", ("packages.lock.json",)),
}


def ecosystem_of(path: Column) -> Column:
    """The ecosystem of a manifest's path by its base name, null for other files."""
    name = F.substring_index(path, "/", -1)
    out = F.when(name.endswith(".csproj"), F.lit("nuget"))
    for manifest, (ecosystem, _) in MANIFESTS.items():
        out = out.when(name == manifest, F.lit(ecosystem))
    return out


def nearest_lockfile(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """Manifests with the lockfile of their own directory (never a parent's), the first that exists by priority."""
    wanted = F.lit(None).cast("array<string>")
    name = F.substring_index("path", "/", -1)
    for manifest, (_, files) in MANIFESTS.items():
        is_it = name.endswith(".csproj") if manifest.startswith("*") else name == manifest
        wanted = F.when(is_it, F.array(*[F.lit(x) for x in files]).cast("array<string>")).otherwise(wanted)
    base = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    asked = manifests.withColumn("__order", wanted).withColumn("__base", base)
    asked = asked.select("*", F.posexplode_outer("__order").alias("__rank", "__lock"))
    have = locks.select(F.col("path").alias("lock_path"))
    found = asked.join(have, F.concat("__base", "__lock") == F.col("lock_path"), "left").where("lock_path IS NOT NULL")
    best = found.groupBy("path").agg(F.min_by("lock_path", "__rank").alias("lock_path")).withColumnRenamed("path", "__path")
    return manifests.join(best, F.col("path") == F.col("__path"), "left").drop("__path")


def with_vouch_names(entries: DataFrame, renames: DataFrame, name: str = "name") -> DataFrame:
    """Adds vouch_name: what the lockfile calls an entry, through renames (name, real_name) where there is one."""
    real = renames.select(F.col("name").alias("__name"), F.col("real_name").alias("__real"))
    return entries.join(real, F.col(name) == F.col("__name"), "left").withColumn("vouch_name", F.coalesce("__real", name)).drop("__name", "__real")


def unvouched(entries: DataFrame, vouched: DataFrame, on: list[str]) -> DataFrame:
    """Entries that no lockfile row names."""
    return entries.join(vouched, on, "left_anti")


def rule_of(ecosystem: Column, section: Column, state: Column, spec: Column, indirect: Column, locked: Column, known: Column) -> Column:
    """The rule that a changed entry falls under, null for removed ones.

    spec: the entry's value now; indirect: whether nothing imports it directly; locked: whether there is a lockfile;
    known: whether that names the entry.
    """
    added = state == "added"
    unknown = added & locked & ~known
    vouches = ecosystem.isin("cargo", "go") | (ecosystem.isin("pyproject", "nuget") & locked)
    return (
        F.when(state == "removed", F.lit(None).cast("string"))
        .when((ecosystem == "npm") & (section == "scripts"), "script-changed")
        .when((ecosystem == "cargo") & (section == "package"), "cargo-build-script")
        .when(state == "modified", "dep-changed")
        .when(added & ecosystem.isin("requirements", "maven"), "dep-added-nolock")
        .when(added & (ecosystem == "go") & indirect & ~unknown, "dep-added-indirect")
        .when(added & vouches & (spec.startswith("path: ") | (spec == "workspace")), "dep-added-local")
        .when(unknown, "dep-not-in-lockfile")
        .when(added & ~locked & (ecosystem != "npm"), "dep-added-nolock")
        .otherwise("dep-added")
    )


def finding(ecosystem: Column, rule: Column) -> Column:
    """A struct of severity and type."""
    out = F.lit(None).cast("struct<severity:string,type:string>")
    for eco, rules in FINDINGS.items():
        for name, (severity, label) in rules.items():
            out = F.when((ecosystem == eco) & (rule == name), F.struct(F.lit(severity).alias("severity"), F.lit(label).alias("type"))).otherwise(out)
    return out


def dependency_findings(rows: DataFrame) -> DataFrame:
    """rows with rule, severity and type; rows: changed entries with ecosystem, section, state, after, indirect, locked and known."""
    c = F.col
    out = rows.withColumn("rule", rule_of(c("ecosystem"), c("section"), c("state"), c("after"), c("indirect"), c("locked"), c("known")))
    found = finding(c("ecosystem"), c("rule"))
    return out.withColumns({"severity": found["severity"], "type": found["type"]})


def loosely_vouched(entries: DataFrame, lock_texts: DataFrame, name: str = "name", text: str = "lock_text", key: str = "manifest") -> DataFrame:
    """Entries with whether their name followed by @ stands in a lockfile text of their key; texts: (key, lock_text)."""
    texts = lock_texts.select(F.col(key).alias("__m"), F.col(text).alias("__text"))
    here = entries.join(texts, F.col(key) == F.col("__m"), "left")
    return here.withColumn("vouched", F.coalesce(F.col("__text").contains(F.concat(name, F.lit("@"))), F.lit(False))).drop("__m", "__text")


# The order in which the sections of a package manifest are told; those of other manifests are sorted.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "scripts")


def ordered(entries: DataFrame, path: str = "path", section: str = "signature") -> DataFrame:
    """Entries with ``pre_ord``, their place in their manifest: by section, as these stand in SECTIONS and else sorted, then by name."""
    place = F.lit(len(SECTIONS))
    for k, name in enumerate(SECTIONS):
        place = F.when(F.col(section) == name, k).otherwise(place)
    place = F.when(F.substring_index(F.col(path), "/", -1) == "package.json", place).otherwise(0)
    return entries.withColumn("pre_ord", F.row_number().over(Window.partitionBy(path).orderBy(place, section, "name")) - 1)


def undeclared(imports: DataFrame, declared: DataFrame, on: str) -> DataFrame:
    return imports.join(declared.select(on).distinct(), on, "left_anti")
