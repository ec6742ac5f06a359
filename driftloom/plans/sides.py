"""Two snapshots made from the driver's documents, in Spark and, for the same rows, in SQL.

What happens to a document depends on the last digit of its id: 0 is new, 1 is gone, 2 gets a word, 3 gets
its blanks doubled, 4 an access key, 5 a call that runs code, 6 a guard that is switched off, 7 weaker cookie flags;
8 and 9 stay as they are. Lines that are added are written in the language that the document's path says, and stand
behind the whole text, as statements of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {"en": ".ts", "de": ".py", "fr": ".rs", "es": ".go"}
#: For each ending of a path: what stands before and after the key's value, the call, the guard, and the cookie, before and after.
LINES: dict[str, dict[str, str]] = {
    ".ts": {
        "key": '\n;\nconst key = "', "end": '";', "call": "\n;\neval(payload);",
        "guard": "\n;\nexport function check(user) {\n  if (isAllowed(user)) { deny(); }\n}", "no_guard": "\n;\nexport function check(user) {\n  if (false) { deny(); }\n}",
        "cookie": "\n;\nconst jar = { httpOnly: true, secure: true };", "weak": "\n;\nconst jar = { path: root };",
    },
    ".py": {
        "key": '\nkey = "', "end": '"', "call": "\neval(payload)",
        "guard": "\nclass Check:\n    def run(self, user):\n        if is_allowed(user):\n            deny()", "no_guard": "\nclass Check:\n    def run(self, user):\n        if False:\n            deny()",
        "cookie": "\njar = cookie(httponly=True, secure=True)", "weak": "\njar = cookie(path=root)",
    },
    ".rs": {
        "key": '\n;\nconst KEY: &str = "', "end": '";', "call": "\n;\nlet child = Command::new(shell);",
        "guard": "\n;\nimpl Check {\n    fn run(&self, user: u8) { if is_allowed(user) { deny(); } }\n}", "no_guard": "\n;\nimpl Check {\n    fn run(&self, user: u8) { if false { deny(); } }\n}",
        "cookie": "\n;\nlet jar = cookie().http_only(true).secure(true);", "weak": "\n;\nlet jar = cookie().path(root);",
    },
    ".go": {
        "key": '\n;\nconst key = "', "end": '"', "call": "\n;\nchild := exec.Command(shell)",
        "guard": "\n;\nvar check = func(user string) { if isAllowed(user) { deny() } }", "no_guard": "\n;\nvar check = func(user string) { if false { deny() } }",
        "cookie": "\n;\nvar jar = http.Cookie{HttpOnly: true, Secure: true}", "weak": "\n;\nvar jar = http.Cookie{Path: root}",
    },
    ".md": {"key": "\nkey: ", "end": "", "call": "\neval(payload)", "guard": "\nguarded", "no_guard": "\nnot guarded", "cookie": "\ncookies are safe", "weak": "\ncookies are not"},
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, path, before, after of every document."""
    docs, text, digit = documents(spark, sf_dir), F.coalesce(F.col("text"), F.lit("")), F.col("doc_id") % 10
    extension = F.lit(".md")
    for lang, suffix in EXTENSIONS.items():
        extension = F.when(F.col("lang") == lang, suffix).otherwise(extension)

    def line(kind: str) -> Column:
        out = F.lit(LINES[".md"][kind])
        for lang, suffix in EXTENSIONS.items():
            out = F.when(F.col("lang") == lang, LINES[suffix][kind]).otherwise(out)
        return out

    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16)))
    none = F.lit(None).cast("string")
    before = F.when(digit == 0, none).when(digit == 6, F.concat(text, line("guard"))).when(digit == 7, F.concat(text, line("cookie"))).otherwise(text)
    after = (
        F.when(digit == 1, none)
        .when(digit == 2, F.concat(F.lit("replaced "), text))
        .when(digit == 3, F.replace(text, F.lit(" "), F.lit("  ")))
        .when(digit == 4, F.concat(text, line("key"), key, line("end")))
        .when(digit == 5, F.concat(text, line("call")))
        .when(digit == 6, F.concat(text, line("no_guard")))
        .when(digit == 7, F.concat(text, line("weak")))
        .otherwise(text)
    )
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), extension)
    return docs.select("doc_id", "source", path.alias("path"), before.alias("before"), after.alias("after"))


def changed_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).where(~F.col("before").eqNullSafe(F.col("after")))


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _line(kind: str) -> str:
    return "CASE lang " + " ".join(f"WHEN '{lang}' THEN {_s(LINES[suffix][kind])}" for lang, suffix in EXTENSIONS.items()) + f" ELSE {_s(LINES['.md'][kind])} END"


SIDES = f"""sides AS (
  SELECT doc_id, source, source || '/doc_' || doc_id || CASE lang {" ".join(f"WHEN '{lang}' THEN '{suffix}'" for lang, suffix in EXTENSIONS.items())} ELSE '.md' END AS path,
    CASE doc_id % 10 WHEN 0 THEN NULL WHEN 6 THEN t || {_line("guard")} WHEN 7 THEN t || {_line("cookie")} ELSE t END AS before,
    CASE doc_id % 10 WHEN 1 THEN NULL WHEN 2 THEN 'replaced ' || t WHEN 3 THEN replace(t, ' ', '  ')
      WHEN 4 THEN t || {_line("key")} || 'AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || {_line("end")}
      WHEN 5 THEN t || {_line("call")} WHEN 6 THEN t || {_line("no_guard")} WHEN 7 THEN t || {_line("weak")} ELSE t END AS after
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
)"""

#: Flags of changed files by regular expressions over their whole texts, the first rule that matches; needs SIDES before it.
FLAGS = r"""looked AS (
  SELECT doc_id, source, path, before, after, regexp_extract(path, '\.(\w+)$', 1) AS kind, coalesce(before, '') AS b FROM sides WHERE before IS DISTINCT FROM after AND after IS NOT NULL
), flags AS (
  SELECT doc_id, source, path, after, CASE
    WHEN kind <> 'md' AND (regexp_matches(after, 'AKIA[0-9A-Z]{16}') OR regexp_matches(after, '\bsk-[A-Za-z0-9]{16,}')) THEN 'hardcoded-secret'
    WHEN kind = 'ts' AND regexp_matches(after, '\beval\s*\(') AND NOT regexp_matches(b, '\beval\s*\(') THEN 'eval-call'
    WHEN kind = 'py' AND regexp_matches(after, '\b(eval|exec|compile)\s*\(') AND NOT regexp_matches(b, '\b(eval|exec|compile)\s*\(') THEN 'eval-call'
    WHEN kind = 'rs' AND regexp_matches(after, 'Command::new\s*\(') AND NOT regexp_matches(b, 'Command::new\s*\(') THEN 'child-process'
    WHEN kind = 'go' AND regexp_matches(after, '\bexec\.Command(Context)?\s*\(') AND NOT regexp_matches(b, '\bexec\.Command(Context)?\s*\(') THEN 'child-process'
    WHEN kind = 'ts' AND regexp_matches(b, 'httpOnly\s*:\s*true') AND NOT regexp_matches(after, 'httpOnly\s*:\s*true') THEN 'cookie-httponly-removed'
    WHEN kind = 'py' AND regexp_matches(b, 'httponly\s*=\s*True') AND NOT regexp_matches(after, 'httponly\s*=\s*True') THEN 'cookie-httponly-removed'
    WHEN kind = 'rs' AND regexp_matches(b, '\.http_only\s*\(\s*true\s*\)') AND NOT regexp_matches(after, '\.http_only\s*\(\s*true\s*\)') THEN 'cookie-httponly-removed'
    WHEN kind = 'go' AND regexp_matches(b, 'HttpOnly\s*:\s*true') AND NOT regexp_matches(after, 'HttpOnly\s*:\s*true') THEN 'cookie-httponly-removed'
    WHEN kind = 'ts' AND before IS NOT NULL AND regexp_matches(after, '\bif\s*\(\s*false\s*\)') AND NOT regexp_matches(b, '\bif\s*\(\s*false\s*\)') THEN 'removed-if-guard'
    WHEN kind = 'py' AND before IS NOT NULL AND regexp_matches(after, '\bif\s+False\s*:') AND NOT regexp_matches(b, '\bif\s+False\s*:') THEN 'removed-if-guard'
    WHEN kind IN ('rs', 'go') AND before IS NOT NULL AND regexp_matches(after, '\bif\s+false\s*\{') AND NOT regexp_matches(b, '\bif\s+false\s*\{') THEN 'removed-if-guard'
  END AS rule FROM looked
), rated AS (
  SELECT *, CASE WHEN rule = 'removed-if-guard' THEN 'low' ELSE 'high' END AS severity, rule || '@' || regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') AS flag_id, md5(after) AS node_hash FROM flags WHERE rule IS NOT NULL
), judged AS (
  SELECT r.*, l.doc_id IS NOT NULL AS dismissed FROM rated r LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON r.doc_id = l.doc_id AND r.doc_id % 3 = 0
)"""
