"""Scanning of source files: findings by rule, excuses and severities by context, signals, hooks, manifests, axes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weftline.functions.exprs import computed_once
from weftline.functions.lines import BLANK, found_lines
from weftline.operators import rule_values as v
from weftline.operators.scanner import CATEGORY, COMMENT, EXPECTED, SIDE_PATHS, SUPPRESS, composite, first_matches, lines, nearest

MIGRATION_OR_SETUP = r"(?:^|/)(?:migrations|alembic|versions|migrate)(?:/|$)|(?i:(?:^|/)(?:setup\.py|setup\.cfg|conftest\.py)$)"
SHELL, NO_SHELL = "shell=True|shell = True", "shell=False|shell = False"


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def language(path: Column) -> Column:
    """The language of a file by its ending, else null."""
    names = F.create_map(*[F.lit(x) for kv in v.LANGUAGE_OF.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"[^/.]\.([A-Za-z]+)$", 1)))


def has(*words: str) -> Column:
    """Whether the lower-case line holds one of the words: far cheaper than a pattern."""
    return reduce(or_, (F.contains("_low", F.lit(w)) for w in words))


def gates() -> dict[str, Column]:
    """What a line must hold to have a finding of a category; the category's rules are tried only there."""
    return {
        "secret": has("akia", "sk-", "-----begin", "ghp_", "ghs_", "xox") | (has("=", ":") & has("'", '"')),
        "unsafe_exec": has("(", "[", "child_process", "shell"),
        "insecure_deserialization": has("load", "decode", "allow_pickle", "objectinputstream") & has("(", "allow_pickle", "marshal.load", "yaml.unsafe_load"),
        "fs_access": has("("),
        "exfiltration": has("(", "webhook.site", "requestbin", "pipedream", "ngrok", "burp", "interact.sh", "b64encode", "os.environ", "gethostbyname", "dns.resolve"),
        "dynamic_remote_load": has("(", "|", "://", "npx", "uvx"),
        "hidden_unicode": ((F.octet_length("content") > F.length("content")) & F.col("content").rlike(r"[\x{E0000}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200D}\x{2060}\x{180E}]")) | has("\x1b"),
        "prompt_injection": (has("ignore") & has("instruction")) | has("disregard", "user") | (has("hide") & has("from")) | (has("<") & has("system", "important", "instruction"))
        | (has("system") & has("prompt")) | (has("you") & has("now")) | (has("your") & has("instruction", "task", "role")) | (has("send") & has("://")) | (has("before") & has("tool")),
        "obfuscation": has("(", "\\x"),
    }


# Words, in RE2's syntax and either case, of which a line must hold one before the patterns of a list can match it.

#: Network reads beside places that run code.
NEAR_CODE = rf"(?i)(?:requests|httpx|axios)\.|urlopen|(?:fetch|eval|exec|function){BLANK}*\(|vm\.run|(?:pickle|marshal)\.|importlib\."
#: The legs of a toxic flow.
FLOW_WORDS = (
    r"(?i)os\.environ|getenv|process\.env|\.ssh/|\.aws/|\.netrc|id_rsa|/\.env|\.pem|keyring\.|keychain|secitemcopy|credentialcache"
    rf"|(?:open|fetch|send|send_message){BLANK}*\(|read_text|read_bytes|readfile|glob\.glob|os\.listdir|os\.walk"
    r"|(?:requests|httpx|axios|request|req)\.|urlopen|webhook|smtplib|sendmail|socket\.|(?:slack|discord|telegram)[._]|put_object|upload_file|dns\.resolver"
)
#: The rules of findings.
RULE_WORDS = (
    rf"(?i)akia|sk-|-----begin|gh[ps]_|xox|(?:key|secret|token|password|passwd){BLANK}*[=:]{BLANK}*['\"]"
    rf"|subprocess\.|child_process|shell{BLANK}*=|command::new|(?:popen|eval|exec|system|sync|command|`|%x){BLANK}*[(\[]"
    r"|(?:pickle|marshal|dill|yaml|torch|fs|vm)\.|allow_pickle|objectinputstream"
    rf"|open{BLANK}*\(|rmtree|rimraf|(?:\.post|\.get|fetch|urlopen|function|reversed|rot13|decode){BLANK}*\("
    r"|webhook\.site|requestbin|pipedream|ngrok|burp|interact\.sh|b64encode|os\.environ|gethostbyname|dns\.resolve|https?://|curl|wget|npx|uvx"
    r"|[\x{E0000}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200D}\x{2060}\x{180E}\x1b]"
    rf"|(?:ignore|disregard){BLANK}|(?:the{BLANK}+user|hide{BLANK}+this|system{BLANK}*prompt|you{BLANK}+are{BLANK}+now)|your{BLANK}+(?:new|real|actual)|<{BLANK}*/?{BLANK}*(?:system|important|instruction)|before{BLANK}+(?:using|calling|running)"
    r"|\\x[0-9a-f]|fromcharcode|__builtins__|__import__"
)
#: The signals.
SIGNAL_WORDS = (
    r"(?i)authenticate|verify_token|check_auth|isauthenticated|authorize|check_permission|has_role|require(?:auth|role)|validate|sanitize|escape|zod\.object|pydantic|basemodel|limit|throttle|cors|access-control-allow|content-security-policy|helmet|headers"
    r"|hmac|hashlib\.|cryptography\.|jwt\.|verify_signature|parse\.quote|bleach\.clean|markupsafe|nh3\.clean|dompurify|logging\.getlogger|logger\.|audit_log|structlog"
    rf"|try{BLANK}*:|(?:except|rescue|interface){BLANK}|\.catch|boundary|typing{BLANK}+import|typevar|generic\[|@dataclass|requirements\.txt|\.lock|package-lock\.json"
)
#: The dependencies: a name, and the beginning of its version.
DEPENDENCY_WORDS = rf"(?i)(?:{'|'.join(re.escape(n) for n, *_ in v.DEPENDENCIES)})(?:{BLANK}*[=<>~!]|\"{BLANK}*:)"


def code_lines(files: DataFrame, path_col: str = "path", text_col: str = "text", finds: str | None = None) -> DataFrame:
    """A row per line outside comments, numbered from 1, with what the file's path says; with ``finds`` of lines in which it is found."""
    path = F.coalesce(path_col, F.lit(""))
    facts = [F.col(path_col).alias("path"), language(path).alias("language"), path.rlike(SIDE_PATHS).alias("side"), file_name(path).isin(*v.METADATA_FILES).alias("metadata"), (path.contains(".example") | F.lower(path).contains("test")).alias("no_secrets"), path.rlike(MIGRATION_OR_SETUP).alias("setup"), (file_name(path) == "__init__.py").alias("package")]
    return lines(files, path_col, text_col, finds, *facts).drop("id").where(~F.col("content").rlike(COMMENT)).withColumn("line", (F.col("line") + 1).cast("long"))


def _excused(category: str, name: str, pattern: str) -> Column:
    """Whether the line or the path shows a harmless use of what the rule looks for."""
    c, lowered = F.col("content"), name.lower()
    if category == "secret":
        value = F.lower(F.regexp_extract(c, pattern, 1 if "([" in pattern else 0))
        return F.col("no_secrets") | value.rlike("example|placeholder|your_api_key")
    if category == "fs_access":
        return c.rlike("|".join(v.SAFE_OPEN))
    out = F.lit(False)
    if category == "unsafe_exec" and "subprocess" in lowered:
        out = (~c.rlike(SHELL) & c.rlike(v.SAFE_SUBPROCESS + "|capture_output=True")) | c.rlike(NO_SHELL)
    if category == "unsafe_exec" and ("eval" in lowered or "exec" in lowered):
        out = out | c.rlike(v.SAFE_EVAL) | c.rlike(v.SAFE_DATABASE) | c.rlike("(?i)cursor.*execute|execute.*cursor") | c.rlike(v.SAFE_EXEC_HELPER)
    if category == "unsafe_exec" and "eval" in lowered:
        out = out | (F.col("package") & c.rlike("(?i)version"))
    if category == "unsafe_exec" and "exec" in lowered:
        out = out | F.col("setup")
    return out


def _severity(category: str, severity: str) -> Column:
    """The rule's severity, less for files beside the code and for sandboxed paths, most for a shell."""
    side, c = F.col("side"), F.col("content")
    if category not in ("unsafe_exec", "insecure_deserialization", "fs_access", "dynamic_remote_load", "prompt_injection"):
        return F.lit(severity)
    if category == "prompt_injection":
        side = side & ~F.col("metadata")
    base = F.when(side, "medium").otherwise(severity) if severity in ("critical", "high") else F.lit(severity)
    if category == "unsafe_exec":
        return F.when(c.rlike(SHELL), "critical").otherwise(base)
    if category == "fs_access":
        step = F.when(base == "high", "medium").when(base == "medium", "low").otherwise(base)
        return F.when(c.rlike(r"Path\(|pathlib"), step).otherwise(base)
    return base


def file_findings(files: DataFrame, path_col: str = "path", text_col: str = "text", rules=v.RULES, marker: str = SUPPRESS, allowed: tuple = (), gated: bool = True) -> DataFrame:
    """Findings of all rules in files: path, line, category, name, severity.

    A line has at most one finding of a category: by the first of its rules that matches, is meant for the file's
    language, is not in ``allowed`` (pairs of a path, or its beginning and ``*``, and a rule's name), and is not excused
    by the context. Comments and lines with the marker have none. One pass over the lines of whole texts, with no
    shuffle; ``gated``, an automaton first chooses the lines that hold a word of the rules. Null texts have no lines; null paths count as empty; repeated files are found as often as they
    occur. Classes in patterns are of ASCII characters.
    """
    kept = code_lines(files, path_col, text_col, RULE_WORDS if gated and rules is v.RULES else None).where(~F.contains("content", F.lit(marker)))
    kept = computed_once(kept, _low=F.lower("content"))
    c, path, gate = F.col("content"), F.coalesce("path", F.lit("")), gates() if gated else {}
    parts = []
    for category, own in rules.items():
        first = None
        for name, severity, pattern, languages in own:
            fits = c.rlike(pattern)
            if languages:
                fits = fits & F.coalesce(F.col("language").isin(*languages), F.lit(False))
            for glob, rule in allowed:
                if rule == name:
                    fits = fits & ~(path.startswith(glob[:-1]) if glob.endswith("*") else path == glob)
            fits = fits & ~_excused(category, name, pattern)
            found = F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), _severity(category, severity).alias("severity"))
            first = F.when(fits, found) if first is None else first.when(fits, found)
        parts.append(F.when(gate[category], first) if category in gate else first)
    hit = kept.select("path", "line", F.explode(F.array_compact(F.array(*parts))).alias("f"))
    return hit.select("path", "line", "f.category", "f.name", "f.severity")


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def file_signals(files: DataFrame, path_col: str = "path", text_col: str = "text", marker: str = SUPPRESS) -> DataFrame:
    """For each file which signals its lines hold (array of flags in the order of the list) and its count of suppressed lines.

    Comments, and lines that say example or placeholder, give no signal. The patterns are tried on lines that hold one of
    their words, which one pass over the texts chooses, so nothing is exploded or shuffled. Other columns stay.
    """
    found = found_lines(text_col, f"{SIGNAL_WORDS}|(?-i:{re.escape(marker)})")
    code = F.filter(F.transform(found, lambda x: x["content"]), lambda x: ~x.rlike(COMMENT))
    out = computed_once(files, _code=code)
    out = computed_once(out, _plain=F.filter("_code", lambda x: ~x.rlike("(?i)example|placeholder")))
    flags = [F.exists("_plain", _like(p)) for _, p in v.SIGNALS]
    out = out.withColumns({"signals": F.array(*flags), "suppressions": F.size(F.filter("_code", lambda x: F.contains(x, F.lit(marker)))).cast("long")})
    return out.select(*(files[c] for c in files.columns), "signals", "suppressions")


def remote_then_run(files: DataFrame, within: int = 40, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Files beside tests and builds in which a network read and a place that runs code stand near each other.

    The finding stands at the first network read. Each read takes the nearest such places before and after it from a
    window over the file's own lines, so no pairs are built.
    """
    own = files.where(~F.coalesce(path_col, F.lit("")).rlike(SIDE_PATHS)).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    flags = lambda x: F.struct((x["line"] + 1).cast("long").alias("line"), x["content"].rlike(v.NET_READ).alias("reads"), x["content"].rlike(v.EXEC_SINK).alias("runs"))
    near = computed_once(own, _near=F.transform(found_lines("text", NEAR_CODE), flags))
    near = near.where(F.exists("_near", lambda x: x["reads"]) & F.exists("_near", lambda x: x["runs"])).select("path", F.inline("_near"))
    return nearest(near.where("reads or runs"), "path", "reads", "runs", within).select("path", F.col("first").alias("line"))


def install_hooks(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Scripts of a package that run when it is installed: critical where they fetch, pipe or evaluate, else medium.

    Files that are no JSON objects, and blank or missing scripts, have none.
    """
    own = files.where(file_name(F.coalesce(path_col, F.lit(""))) == "package.json")
    hooks = F.array(*[F.struct(F.lit(h).alias("hook"), F.get_json_object(text_col, f"$.scripts.{h}").alias("command")) for h in v.INSTALL_HOOKS])
    hit = own.select(F.col(path_col).alias("path"), F.explode(hooks).alias("h")).where("trim(h.command) <> ''")
    return hit.select("path", "h.hook", F.when(F.col("h.command").rlike(v.INSTALL_DANGER), "critical").otherwise("medium").alias("severity"))


def _commands(text: str | None) -> list[str]:
    """Each command with its arguments, wherever it is nested, once."""
    try:
        open_nodes = [json.loads(text or "")]
    except ValueError:
        return []
    out: dict[str, None] = {}
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, dict):
            if isinstance(node.get("command"), str):
                args = node.get("args")
                out[" ".join([node["command"], *map(str, args if isinstance(args, list) else ())]).strip()] = None
            node = list(node.values())
        if isinstance(node, list):
            open_nodes += [x for x in node if isinstance(x, dict | list)]
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def manifest_commands(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(_commands)


def manifest_findings(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Commands of manifests that evaluate code, pipe to a shell or fetch scripts: path, command, and the first rule's name and severity."""
    own = files.where(file_name(F.coalesce(path_col, F.lit(""))).isin(*[n for n in v.METADATA_FILES if n.endswith(".json")]))
    c, first = F.col("command"), None
    for name, severity, pattern in v.MANIFEST_RULES:
        found = F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"))
        first = F.when(c.rlike(pattern), found) if first is None else first.when(c.rlike(pattern), found)
    hit = own.select(F.col(path_col).alias("path"), F.explode(manifest_commands(text_col)).alias("command")).withColumn("f", first)
    return hit.where("f is not null").select("path", "command", "f.name", "f.severity")


def all_findings(files: DataFrame, path_col: str = "path", text_col: str = "text", marker: str = SUPPRESS, allowed: tuple = ()) -> DataFrame:
    """Everything the scanners find in files: path, category, name, severity.

    Line rules, network reads beside places that run code, commands of manifests, toxic flows, dependencies with known
    faults and install hooks. Paths are unique.
    """
    fixed = lambda df, category: df.select("path", F.lit(category).alias("category"), "name", "severity")
    path = F.coalesce(F.col(path_col), F.lit(""))
    flows = {"high": "private data, untrusted input, outbound", "medium": "file read, untrusted input, outbound"}
    excused = F.lit(False)
    for glob, rule in allowed:
        if rule in flows.values():
            excused = excused | (path.startswith(glob[:-1]) if glob.endswith("*") else path == glob)
    flow = composite(files, v.LEGS, path_col, text_col, path_col, excused, FLOW_WORDS).withColumnRenamed("id", "path")
    parts = [
        file_findings(files, path_col, text_col, marker=marker, allowed=allowed).select("path", "category", "name", "severity"),
        remote_then_run(files, path_col=path_col, text_col=text_col).select("path", F.lit("dynamic_remote_load").alias("category"), F.lit("network read near code that runs").alias("name"), F.lit("high").alias("severity")),
        fixed(manifest_findings(files, path_col, text_col), "dynamic_remote_load"),
        flow.select("path", F.lit("toxic_flow").alias("category"), F.when(F.col("severity") == "high", flows["high"]).otherwise(flows["medium"]).alias("name"), "severity"),
        fixed(first_matches(files, v.DEPENDENCIES, path_col, text_col, path_col, v.DEPENDENCY_FILES, DEPENDENCY_WORDS).withColumnRenamed("id", "path"), "dependency"),
        install_hooks(files, path_col, text_col).select("path", F.lit("install_hook").alias("category"), F.col("hook").alias("name"), "severity"),
    ]
    return reduce(DataFrame.unionByName, parts)


def source_facts(files: DataFrame, key: str = "source", path_col: str = "path", text_col: str = "text", marker: str = SUPPRESS) -> DataFrame:
    """What a source's files say of it as a whole: a row each, as ``source_scores`` takes it.

    Paths begin at the source's root. positives counts the distinct signals, a lock file being one; practices a readme, a
    licence and tests; a tool server has a manifest of one, or a package file that names its protocol; a media tool says
    so in its name, or has three files of that kind.
    """
    low = F.lower(F.coalesce(F.col(path_col), F.lit("")))
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    anyone = lambda words, c: reduce(or_, (c.contains(w) for w in words))
    k = len(v.SIGNALS)
    signals = file_signals(files, path_col, text_col, marker)
    out = signals.groupBy(F.col(key).alias("source")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("suppressions").alias("suppressions"), *(F.bool_or(F.col("signals")[i] | (name.isin(*v.LOCK_FILES) if v.SIGNALS[i][0] == v.PINNED else F.lit(False))).alias(f"_s{i}") for i in range(k)),
        F.bool_or(low.startswith("readme")).alias("_readme"), F.bool_or(low.rlike("^licen[sc]e")).alias("_licence"), F.bool_or(low.contains("test") | low.contains("spec")).alias("_tests"),
        F.bool_or(name.isin(*v.SERVER_FILES) | (name.isin(*v.PACKAGE_FILES) & anyone(v.SERVER_WORDS, text))).alias("server"), F.count_if(anyone(v.MEDIA_PATHS, low)).alias("_media"),
    )
    count = lambda names: sum((F.col(n).cast("int") for n in names), F.lit(0))
    media = anyone(v.MEDIA_WORDS, F.lower("source")) | (F.col("_media") >= 3)
    return out.select("source", "files", count([f"_s{i}" for i in range(k)]).alias("positives"), count(["_readme", "_licence", "_tests"]).alias("practices"), "suppressions", "server", media.alias("media"))


def axis_scores(found: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """For each source the score of each axis: 100 less the weights of its findings, at least 0.

    ``found`` has the key, category and severity; ``sources`` one row per source, and where it has them the flags
    ``server`` and ``media``: these take a tenth for categories that they have by nature, 1 at least, unless critical.
    Findings are summed before the join.
    """
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    axes = sorted(set(v.AXES.values()))
    weight = F.coalesce(pairs(CATEGORY)[F.col("severity")], F.lit(3))
    axis = pairs(v.AXES)[F.col("category")]
    less = lambda e: F.when(F.col("category").isin(*EXPECTED[e]) & (F.col("severity") != "critical"), F.greatest(F.lit(1), F.floor(weight / 10))).otherwise(weight)
    kinds = {"": weight, "_server": less("server"), "_media": less("media")}
    taken = found.groupBy(key).agg(*(F.sum(F.when(axis == a, w)).alias(a + k) for a in axes for k, w in kinds.items()))
    flag = lambda e: F.coalesce(F.col(e), F.lit(False)) if e in sources.columns else F.lit(False)
    pick = lambda a: F.when(flag("server"), F.col(a + "_server")).when(flag("media"), F.col(a + "_media")).otherwise(F.col(a))
    return sources.join(taken, key, "left").select(key, *(F.greatest(F.lit(0), 100 - F.coalesce(pick(a), F.lit(0))).cast("long").alias(a) for a in axes))
