"""Languages of code blocks: from attributes by a table of names, else from the text by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where attributes name a language, first match first. Fixed values.
ATTRIBUTES = [r"(?i)data-lang(?:uage)?=[\"']([^\"']+)[\"']", r"(?i)class=[\"'][^\"']*(?:language-|lang-)([\w+-]+)", r"(?i)class=[\"'][^\"']*\bhljs\s+([\w+-]+)"]

#: Other names of languages, official ones first, then those that pages use. Fixed values.
ALIASES = {
    "adoc": "asciidoc", "batch": "bat", "be": "berry", "bird": "bird2", "1c": "bsl", "cdc": "cadence", "clj": "clojure", "ql": "codeql",
    "coffeescript": "coffee", "lisp": "common-lisp", "c++": "cpp", "c#": "csharp", "cs": "csharp", "cql": "cypher", "dockerfile": "docker",
    "elisp": "emacs-lisp", "erl": "erlang", "ftl": "fluent", "f": "fortran-fixed-form", "for": "fortran-fixed-form", "f77": "fortran-fixed-form",
    "f90": "fortran-free-form", "f95": "fortran-free-form", "f03": "fortran-free-form", "f08": "fortran-free-form", "f18": "fortran-free-form",
    "f#": "fsharp", "fs": "fsharp", "tscn": "gdresource", "tres": "gdresource", "gd": "gdscript", "gjs": "glimmer-js", "gts": "glimmer-ts",
    "gql": "graphql", "hbs": "handlebars", "hs": "haskell", "properties": "ini", "js": "javascript", "cjs": "javascript", "mjs": "javascript",
    "fsl": "jssm", "jl": "julia", "kt": "kotlin", "kts": "kotlin", "kql": "kusto", "lean4": "lean", "makefile": "make", "md": "markdown",
    "mmd": "mermaid", "mips": "mipsasm", "mbt": "moonbit", "mbti": "moonbit", "nar": "narrat", "nf": "nextflow", "objc": "objective-c",
    "nu": "nushell", "scad": "openscad", "pot": "po", "potx": "po", "ps": "powershell", "ps1": "powershell", "protobuf": "proto", "jade": "pug",
    "py": "python", "perl6": "raku", "regex": "regexp", "rb": "ruby", "rs": "rust", "1c-query": "sdbl", "shader": "shaderlab", "bash": "shellscript",
    "sh": "shellscript", "shell": "shellscript", "zsh": "shellscript", "console": "shellsession", "closure-templates": "soy", "spl": "splunk",
    "styl": "stylus", "surql": "surrealql", "talon": "talonscript", "tf": "terraform", "tfvars": "terraform", "lit": "ts-tags", "ts": "typescript",
    "cts": "typescript", "mts": "typescript", "tsp": "typespec", "typ": "typst", "cmd": "vb", "vim": "viml", "vimscript": "viml", "vy": "vyper",
    "文言": "wenyan", "mediawiki": "wikitext", "wiki": "wikitext", "wl": "wolfram", "yml": "yaml", "golang": "go", "python3": "python", "py3": "python",
    "python2": "python", "py2": "python", "node": "javascript", "nodejs": "javascript", "jscript": "javascript", "shell-session": "shellsession",
    "bash-session": "shellsession", "sh-session": "shellsession", "zsh-session": "shellsession", "terminal": "shellsession",
    "terminal-output": "shellsession", "cmdline": "shellsession", "env": "dotenv", "docker-compose": "yaml", "compose": "yaml", "postgres": "sql",
    "postgresql": "sql", "psql": "sql", "mysql": "sql", "sqlite": "sql", "conf": "ini", "cfg": "ini", "plist": "xml", "objectivec": "objective-c",
    "obj-c": "objective-c", "cxx": "cpp", "cc": "cpp", "hh": "cpp", "hpp": "cpp", "psm1": "powershell", "powershellscript": "powershell",
    "proto3": "proto", "plain": "text", "plaintext": "text", "txt": "text", "none": "text", "nohighlight": "text", "no-highlight": "text",
}

_POSIX = r"(?:(?:\.{1,2}/|~/|/)\S+|(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+)"
_WINDOWS = r"(?:[A-Za-z]:\\\S+|\\\\\S+\\\S+)"
_REACT = r"(?i)\b(import\s+react\b|from\s+['\"]react['\"]|from\s+['\"]next/|use(?:state|effect|memo|callback)\b)"
_SECTION = r"(?m)^\[[^\]\n]+\]\s*$"

#: Languages with the patterns that tell them: any of the lists, of which all patterns must be found ("!": must not). The
#: first that fits wins. JSON stands for text that parses as such. Fixed values.
RULES: list[tuple[str, list[list[str]]]] = [
    ("diff", [[r"(?im)^diff --git\b"], [r"(?m)^@@\s+[-+]"], [r"(?m)^(?:\+\+\+|---)\s+\S+"]]),
    ("php", [[r"(?i)^<\?php\b"]]),
    ("docker", [[r"(?i)\bfrom\s+[^\n]+\n(?:\s*\w+\s+.+\n)*(?:\s*run|cmd|entrypoint|copy|add|workdir|expose|env|arg|user|label|volume|healthcheck)\b"], [r"(?im)^(?:from|run|cmd|entrypoint|copy|add|workdir|expose|env|arg|user|label|volume|healthcheck)\b"]]),
    ("tsx", [[_REACT, r"<\w[\s\S]*>", r": \s*(React\.)?[A-Z]\w+|interface\s+\w+Props|type\s+\w+\s*="]]),
    ("jsx", [[_REACT, r"<\w[\s\S]*>"]]),
    ("vue", [[r"(?i)<template\b[\s\S]*</template>"], [r"(?i)<script\s+setup\b"]]),
    ("terraform", [[r"(?i)\b(terraform|required_providers|provider|resource|module|variable|output|locals)\b[\s\S]*?="], [r"(?i)\bresource\s+\"[^\"]+\"\s+\"[^\"]+\""]]),
    ("json", [[r"^[{\[]", "JSON"]]),
    ("powershell", [[rf"^{_WINDOWS}(?:\s*\n\s*{_WINDOWS})*$"]]),
    ("shellscript", [[rf"^{_POSIX}(?:\s*\n\s*{_POSIX})*$"]]),
    ("html", [[r"(?i)^<!doctype html\b"], [r"(?i)</?(html|head|body|div|span|section|article|script|style|main|header|footer)\b"]]),
    ("xml", [[r"(?i)^<\?xml\b"], [r"(?i)</?[a-z_][\w:.-]*\b[^>]*>"]]),
    ("toml", [[_SECTION, r"(?m)^\s*[\w.-]+\s*=\s*.+$"]]),
    ("ini", [[_SECTION, r"(?m)^\s*[\w.-]+\s*[:=]\s*.+$"]]),
    ("yaml", [[r"(?m)^[\w.-]+\s*:\s*.+$", "![{};]"], [r"(?m)^-\s+\w[^:]*:\s*.+$", "![{};]"]]),
    ("sql", [[r"(?i)\b(select|insert|update|delete|create|alter|drop|with)\b[\s\S]*\b(from|into|table)\b"]]),
    ("shellscript", [[r"(?m)^#!.*\b(bash|sh|zsh)\b"], [r"(?:^|\n)\s*(export|echo|npm|pnpm|yarn|curl|grep|awk|sed|chmod|mkdir|ls)\b"], [r"(?:^|\n)\s*\$\s+\S+"]]),
    ("powershell", [[r"(?i)\b(get-[a-z]+|set-[a-z]+|write-host|write-output|foreach-object|where-object)\b"], [r"(?i)\$env:[a-z_][\w-]*"], [r"(?i)\bparam\s*\("]]),
    ("go", [[r"(?i)\bpackage\s+main\b"], [r"(?i)\bfunc\s+\w+\s*\("], [r"(?i)\bfmt\.\w+\("]]),
    ("csharp", [[r"(?i)\busing\s+system\b"], [r"(?i)\bconsole\.writeline\s*\("], [r"\bnamespace\s+[A-Z][\w.]*"]]),
    ("java", [[r"(?i)\bpublic\s+(class|interface|enum)\b"], [r"(?i)\bpublic\s+static\s+void\s+main\b"], [r"(?i)\b(system\.out|import\s+java\.)"]]),
    ("kotlin", [[r"(?i)\bfun\s+main\s*\("], [r"(?i)\bdata\s+class\b"], [r"(?i)\bval\s+\w+\s*[:=]", r"(?i)\bprintln\s*\("]]),
    ("swift", [[r"(?i)\bimport\s+(swiftui|foundation)\b"], [r"(?i)\bstruct\s+\w+\s*:\s*view\b"]]),
    ("python", [[r"(?i)\bdef\s+\w+\s*\("], [r"(?i)\bfrom\s+\w+(?:\.\w+)*\s+import\b"], [r"(?i)\bif\s+__name__\s*==\s*['\"]__main__['\"]"], [r"(?i)\bprint\s*\("]]),
    ("ruby", [[r"\bclass\s+\w+\b", r"\bdef\s+\w+[!?=]?\b", r"(?i)\bend\b"], [r"\bputs\s+['\"]"], [r"\brequire\s+['\"][^'\"]+['\"]"]]),
    ("rust", [[r"(?i)\bfn\s+\w+\s*\("], [r"(?i)\blet\s+mut\b"], [r"(?i)\bprintln!\s*\("]]),
    ("cpp", [[r"(?m)^\s*#include\s+<[^>]+>", r"\bstd::|cout\s*<<|<iostream>"]]),
    ("c", [[r"(?m)^\s*#include\s+<[^>]+>"]]),
    ("css", [[r"[.#]?[a-z-][\w-]*\s*\{[\s\S]*:[^;]+;"]]),
    ("typescript", [[r"(?i)\binterface\s+\w+\b"], [r"(?i)\btype\s+\w+\s*="], [r"(?i)\bimport\s+type\b"], [r"(?i):\s*(string|number|boolean|unknown|never|void|any)(\[\])?[\s,)=;]"]]),
    ("javascript", [[r"(?i)\b(const|let|var)\b"], [r"(?i)\bfunction\s+\w+\s*\("], [r"=>"], [r"(?i)\bconsole\.\w+\("]]),
]


def inferred(text: Column) -> Column:
    """The language that the text of a code block looks like, or null."""
    sample = F.regexp_replace(text, r"^\s+|\s+$", "")

    def holds(pattern: str) -> Column:
        if pattern == "JSON":
            return F.try_parse_json(sample).isNotNull()
        return ~sample.rlike(pattern[1:]) if pattern.startswith("!") else sample.rlike(pattern)

    out = F.when(sample == "", F.lit(None).cast("string"))
    for language, ways in RULES:
        fits = F.lit(False)
        for way in ways:
            every = F.lit(True)
            for pattern in way:
                every = every & holds(pattern)
            fits = fits | every
        out = out.when(fits, language)
    return out


def inferred_sql(text: str) -> str:
    """``inferred`` as SQL with RE2 patterns."""
    one = lambda p: f"json_valid({text})" if p == "JSON" else ("NOT " if p[0] == "!" else "") + "regexp_matches({}, '{}')".format(text, p.lstrip("!").replace("'", "''"))
    cases = [f"WHEN {' OR '.join('(' + ' AND '.join(map(one, way)) + ')' for way in ways)} THEN '{language}'" for language, ways in RULES]
    return f"CASE WHEN {text} = '' THEN NULL {' '.join(cases)} END"


def alias_rows(spark: SparkSession) -> DataFrame:
    """ALIASES as rows (alias, language)."""
    return spark.createDataFrame(list(ALIASES.items()), "alias string, language string")


def language_rows(spark: SparkSession, more: list[str] | None = None) -> DataFrame:
    """(language): the languages that aliases and rules name, and ``more`` (a highlighter's whole list has over 200)."""
    return spark.createDataFrame([(x,) for x in sorted({*ALIASES.values(), *(name for name, _ in RULES), *(more or [])})], "language string")


def named(blocks: DataFrame, aliases: DataFrame, languages: DataFrame) -> DataFrame:
    """Adds ``language`` to blocks (attributes): what the attributes name, by ``aliases`` (alias, language), else if it is one of
    ``languages`` (language), else null. Both tables are small rule tables, and what doesn't match stays."""
    raw = F.coalesce(*[F.nullif(F.regexp_extract("attributes", p, 1), F.lit("")) for p in ATTRIBUTES])
    rows = blocks.withColumn("_raw", F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")))
    known = languages.select(F.col("language").alias("_id")).distinct()
    also = aliases.dropDuplicates(["alias"]).select(F.col("alias").alias("_alias"), F.col("language").alias("_of"))
    out = rows.join(F.broadcast(also), F.col("_raw") == F.col("_alias"), "left").join(F.broadcast(known), F.col("_raw") == F.col("_id"), "left")
    return out.withColumn("language", F.coalesce("_of", "_id")).drop("_raw", "_alias", "_of", "_id")
