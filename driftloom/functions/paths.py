"""Projections over repository paths: language, roles, parts, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by path suffix, their labels and families.
SUFFIXES = {
    ".ts": "ts",
    ".tsx": "tsx",
    ".jsx": "jsx",
    ".js": "js",
    ".mjs": "js",
    ".cjs": "js",
    ".rs": "rust",
    ".go": "go",
    ".py": "python",
    ".pyi": "python",
    ".java": "java",
    ".cs": "csharp",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
}
LABELS = {
    "ts": "TypeScript",
    "tsx": "TSX",
    "js": "JavaScript",
    "jsx": "JSX",
    "rust": "Rust",
    "go": "Go",
    "python": "Python",
    "java": "Java",
    "csharp": "C#",
    "kotlin": "Kotlin",
    "swift": "Swift",
}
FAMILIES = {k: "jsts" if k in ("ts", "tsx", "js", "jsx") else k for k in LABELS}
ALWAYS_IGNORED = (".git", "node_modules", ".turbo")
GENERATED = ("dist", "build", "target", ".next", "coverage", "out")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def lang_of(path: Column) -> Column:
    """The language's key, null for declaration files and all that is not parsed."""
    low = F.lower(path)
    out = F.when(low.endswith(".d.ts"), F.lit(None).cast("string"))
    for suffix, lang in SUFFIXES.items():
        out = out.when(low.endswith(suffix), F.lit(lang))
    return out


def label_of(lang: Column) -> Column:
    return _lookup(LABELS, lang)


def family_of(lang: Column) -> Column:
    return _lookup(FAMILIES, lang)


def is_analyzable(path: Column) -> Column:
    return lang_of(path).isNotNull()


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """The directory with its trailing slash, empty for the root."""
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def is_nested(path: Column) -> Column:
    return path.contains("/")


def is_test_path(path: Column) -> Column:
    """Test, mock, story and fixture paths; class names count only with a capital T after a stem."""
    whole = slashed(path)
    low, name, low_name = F.lower(whole), file_name(whole), F.lower(file_name(whole))
    return (
        low.rlike(r"\.test\.|\.spec\.|\.stories\.|__tests__|__mocks__|(^|/)(test|tests|fixtures)/")
        | low_name.contains(".case.")
        | low_name.rlike(r"_test\.go$|^test_.*\.py$|_test\.py$|^conftest\.py$")
        | name.rlike(r"^.+Tests?\.(?i:java|cs|kt|swift)$")
    )


def is_build_script(path: Column) -> Column:
    return F.lower(file_name(slashed(path))) == "build.rs"


def sanitize_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def slug(text: Column) -> Column:
    return F.substring(sanitize_id(text), 1, 24)


def has_component(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(slashed(path), "/"), F.array(*[F.lit(n) for n in names]))


def is_always_ignored(path: Column) -> Column:
    return has_component(path, ALWAYS_IGNORED)


def is_generated(path: Column) -> Column:
    return has_component(path, GENERATED)


def is_temp_file(path: Column) -> Column:
    name = file_name(slashed(path))
    return F.lower(name).rlike(r"~$|\.(tmp|swp|swx|crswap)$|^\.#") | (name == "4913")


def is_git_state(path: Column) -> Column:
    """Whether a path inside the metadata directory says that the baseline may have moved."""
    return path.rlike(r"^\.git/(HEAD|index|packed-refs|ORIG_HEAD|MERGE_HEAD|refs/stash|refs/heads/.+|refs/remotes/.+)$")
