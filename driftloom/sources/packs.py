"""What the rules look for in each family of languages."""

from __future__ import annotations

from dataclasses import dataclass

# Every pattern, literal and marker below.


@dataclass(frozen=True)
class Pack:
    falsy: tuple[str, ...] = ("false",)
    exits: tuple[str, ...] = ("return", "throw", "break", "continue")
    handling: str = "try"  # how failures are handled: try blocks, unwraps, or guards
    unwraps: tuple[str, ...] = ()
    handled: tuple[str, ...] = ()
    subprocess_import: str | None = None
    import_in_strings: bool = False
    subprocess_call: str | None = None
    tls: str | None = None
    env_tls: str | None = None
    evaluates: str | None = None
    compiles_regex: str | None = None
    cors: str | None = None
    cors_in_strings: bool = True
    http_only: str | None = None
    secure: str | None = None
    same_site: str | None = None
    same_site_weak: str | None = None
    same_site_in_strings: bool = True


PACKS: dict[str, Pack] = {
    "jsts": Pack(
        falsy=("false", "0", "null", "undefined"),
        env_tls=r"""NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0""",
        subprocess_import=r"""(require\s*\(\s*['"](?:node:)?child_process['"]|from\s+['"](?:node:)?child_process['"])""",
        import_in_strings=True,
        subprocess_call=r"\.(exec|execSync|spawn|spawnSync)\s*\(",
        http_only=r"httpOnly\s*:\s*true",
        secure=r"secure\s*:\s*true",
        same_site=r"""sameSite\s*:\s*['"]?(Strict|Lax|strict|lax)""",
        same_site_weak=r"""sameSite\s*:\s*['"]?(None|none)""",
    ),
    "rust": Pack(
        exits=("return", "break", "continue", "panic!", "unreachable!", "todo!"),
        handling="unwrap",
        unwraps=(".unwrap(", ".expect("),
        handled=("?", "match ", "if let "),
        subprocess_import=r"std::process::Command",
        subprocess_call=r"Command::new\s*\(|Command[\s\S]*?\.(spawn|output|status)\s*\(",
        tls=r"\.danger_accept_invalid_certs\s*\(\s*true\s*\)|\.danger_accept_invalid_hostnames\s*\(\s*true\s*\)",
        compiles_regex=r'Regex::new\s*\(\s*r?"([^"]*)"',
        cors=r"CorsLayer::(very_permissive|permissive)\s*\(\)|Cors::permissive\s*\(\)|\.allow_origin\s*\(\s*Any\s*\)",
        cors_in_strings=False,
        http_only=r"\.http_only\s*\(\s*true\s*\)",
        secure=r"\.secure\s*\(\s*true\s*\)",
        same_site=r"\.same_site\s*\(\s*SameSite::(Strict|Lax)\s*\)",
        same_site_weak=r"\.same_site\s*\(\s*SameSite::None\s*\)",
        same_site_in_strings=False,
    ),
    "go": Pack(
        exits=("return", "panic", "break", "continue"),
        handling="guards",
        subprocess_import=r"""["']os/exec["']""",
        import_in_strings=True,
        subprocess_call=r"\bexec\.Command(Context)?\s*\(",
        tls=r"InsecureSkipVerify\s*:\s*true",
        compiles_regex=r"""regexp\.(?:MustCompile|Compile|CompilePOSIX|MustCompilePOSIX)\s*\(\s*[`"]([^`"]*)[`"]""",
        cors=r"""(AllowAllOrigins\s*:\s*true|Allow(?:ed)?Origins\s*:\s*\[\]string\{[^}]*"\*"|AllowedOrigins\s*\(\s*\[\]string\{[^}]*"\*"|Access-Control-Allow-Origin["'\s,)]*\*)""",
        http_only=r"HttpOnly\s*:\s*true",
        secure=r"Secure\s*:\s*true",
        same_site=r"SameSite\s*:\s*http\.SameSite(?:Strict|Lax)Mode",
        same_site_weak=r"SameSite\s*:\s*http\.SameSiteNoneMode",
    ),
    "python": Pack(
        falsy=("False", "None", "0"),
        exits=("return", "raise", "break", "continue"),
        subprocess_import=r"(?m)^\s*(import\s+subprocess|from\s+subprocess\s+import)\b",
        subprocess_call=r"\b(subprocess\.(run|call|Popen|check_output|check_call)|os\.(system|popen))\s*\(",
        tls=r"(verify\s*=\s*False|ssl\.CERT_NONE|_create_unverified_context)",
        env_tls=r"""PYTHONHTTPSVERIFY["']?\s*[\],]?\s*[=,]\s*["']?0""",
        evaluates=r"\b(eval|exec|compile)\s*\(",
        compiles_regex=r"""re\.compile\(\s*["']([^"']*)""",
        cors=r"""(allow_origins\s*=\s*\[\s*["']\*["']|origins\s*=\s*["']\*["']|CORS_ORIGIN_ALLOW_ALL\s*=\s*True)""",
        http_only=r"httponly\s*=\s*True",
        secure=r"secure\s*=\s*True",
        same_site=r"""samesite\s*=\s*["'](Lax|Strict|lax|strict)""",
        same_site_weak=r"""samesite\s*=\s*["'](None|none)""",
    ),
    "java": Pack(
        subprocess_call=r"(?:Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(|\bnew\s+ProcessBuilder\s*\()",
        tls=r"(?:ALLOW_ALL_HOSTNAME_VERIFIER|NoopHostnameVerifier|new\s+TrustAllStrategy|setHostnameVerifier\s*\(\s*\([^)]*\)\s*->\s*true|verify\s*\([^)]*\)\s*\{[^}]*return\s+true)",
        evaluates=r"(?:new\s+ScriptEngineManager\s*\(|getEngineByName\s*\(|ScriptEngine\b[^;]*\.\s*eval\s*\()",
        compiles_regex=r'Pattern\s*\.\s*compile\s*\(\s*"([^"]*)"',
        cors=r"""(?:@CrossOrigin\s*\([^)]*origins\s*=\s*"\*"|addAllowedOrigin\s*\(\s*"\*"|setAllowedOrigins\s*\([^)]*"\*"|allowedOrigins\s*\(\s*"\*")""",
        http_only=r"setHttpOnly\s*\(\s*true\s*\)",
        secure=r"setSecure\s*\(\s*true\s*\)",
        same_site=r"""(?i)SameSite\s*[=(]\s*"?(?:Strict|Lax)""",
        same_site_weak=r"""(?i)SameSite\s*[=(]\s*"?None""",
    ),
    "csharp": Pack(
        subprocess_call=r"\b(Process\s*\.\s*Start|new\s+ProcessStartInfo)\b",
        evaluates=r"\bCSharpScript\s*\.\s*(?:EvaluateAsync|RunAsync|Create|Run)\b",
        tls=r"(?:DangerousAcceptAnyServerCertificateValidator|(?:ServerCertificateCustomValidationCallback|ServerCertificateValidationCallback)\s*\+?=\s*(?:\([^)]*\)\s*=>\s*true\b|\([^)]*\)\s*=>\s*\{[^}]*return\s+true\b|delegate\s*(?:\([^)]*\))?\s*\{[^}]*return\s+true\b))",
        compiles_regex=r"""(?:new\s+Regex\s*\(\s*|Regex\s*\.\s*(?:IsMatch|Match)\s*\([^,]*,\s*)@?"([^"]*)\"""",
        cors=r"""(AllowAnyOrigin\s*\(|WithOrigins\s*\([^)]*"\*")""",
        http_only=r"HttpOnly\s*=\s*true",
        secure=r"(Secure\s*=\s*true|CookieSecurePolicy\s*\.\s*Always)",
        same_site=r"SameSite\s*=\s*SameSiteMode\s*\.\s*(Strict|Lax)",
        same_site_weak=r"SameSite\s*=\s*SameSiteMode\s*\.\s*None",
    ),
    "kotlin": Pack(
        evaluates=r"\bgetEngineByName\s*\(",
        subprocess_import=r"import\s+java\.lang\.ProcessBuilder|import\s+java\.lang\.Runtime",
        subprocess_call=r"\bProcessBuilder\s*\(|Runtime\.getRuntime\(\)\.exec\s*\(|\.getRuntime\(\)\.exec\s*\(",
        tls=r"object\s*:\s*X509TrustManager|HostnameVerifier\s*\{[^}]*->\s*true|hostnameVerifier\s*=?\s*\{[^}]*->\s*true",
        compiles_regex=r'(?:\bRegex|Pattern\.compile)\s*\(\s*"([^"]*)"',
        cors=r"""origins\s*=\s*\[?\s*"\*"|allowedOrigins\s*\(\s*"\*"|\banyHost\s*\(\s*\)""",
        http_only=r"setHttpOnly\s*\(\s*true\s*\)|httpOnly\s*=\s*true",
        secure=r"setSecure\s*\(\s*true\s*\)|\bsecure\s*=\s*true",
        same_site=r"""[Ss]ameSite\s*[=(]\s*"?(Strict|Lax|strict|lax)""",
        same_site_weak=r"""[Ss]ameSite\s*[=(]\s*"?(None|none)""",
    ),
    "swift": Pack(
        subprocess_call=r"(\bProcess\s*\(\s*\)|\bNSTask\s*\(|\.launchPath\s*=|\.executableURL\s*=|/bin/(?:ba)?sh)",
        tls=r"(URLCredential\s*\(\s*trust\s*:|DisabledTrustEvaluator|disableEvaluation|allowInvalidCertificates\s*:\s*true)",
        compiles_regex=r'(?:NSRegularExpression|Regex)\s*\(\s*(?:pattern\s*:\s*)?"([^"]*)"',
        cors=r"""allowedOrigin\s*:\s*(?:\.all\b|\.custom\s*\(\s*"\*"|"\*")""",
    ),
}
