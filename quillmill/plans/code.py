"""Queries over code blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import code as C
from quillmill.plans.registry import Registry, derived, same

registry = Registry()
query = registry.add

#: A code text for each rule, with ~ for a line break, ^ for a backslash in SQL and @ for the order.
SAMPLES = [
    "diff --git a/@ b/@", "@@ -1 +1 @@", "+++ b/file@", "<?php echo @;", "FROM alpine~RUN make @", "# build @~  FROM alpine~  RUN make", "import React from \"react\"~const a@ = <b>x</b>", "import React from \"react\"~type T@ = 1~<b>x</b>", "<template><p>@</p></template>",
    "resource \"a\" \"b@\" {}", "{\"a\": @}", "[1, @", "C:\\dir\\file@", "./run/@~/usr/bin", "src/app/@.ts", "<!DOCTYPE html> @", "<note n=\"@\">x</note>", "[part@]~name = value", "[part@]~name: value", "name: value @", "- item: @",
    "SELECT @ FROM t", "#!/bin/bash~@", "npm install x@", "$ go @", "Get-ChildItem @", "package main // @", "using System; // @", "public class A@ ()", "data class A@(x)", "import SwiftUI // @", "def run@(x)", "puts \"@\"", "fn main@() -> x",
    "#include <iostream>~@", "#include <stdio.h>~@", ".box@ { color: red; }", "interface A@ x", "const a = @;", "plain words @", " ~ ",
]
_WHEN = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAMPLES)).replace("\\", "^").replace("{", "{{").replace("}", "}}")
CODES = f"SELECT o_orderkey, replace(replace(replace(CASE o_orderkey % {len(SAMPLES)} {_WHEN} END, '~', chr(10)), '^', chr(92)), '@', CAST(o_orderkey AS STRING)) AS code FROM {{orders}}"

#: Attributes with every name that is known, in turn, in each of the places that may hold one.
NAMES = [*C.ALIASES, *sorted({*C.ALIASES.values(), *(name for name, _ in C.RULES)}), "nothing", "Py", " JS "]
_NAME = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))
BLOCKS = f"""SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN concat('data-lang="', name, '" class="language-python"') WHEN 1 THEN concat('class="code language-', name, '"') WHEN 2 THEN concat('class="hljs ', name, '"') WHEN 3 THEN concat('class="lang-', name, '"')
  WHEN 4 THEN concat('data-language=" ', upper(name), ' "') ELSE 'id="x" class="hljs"' END AS attributes FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % {len(NAMES)} {_NAME} END AS name FROM {{orders}})"""
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in C.ALIASES.items())
_KNOWN = ", ".join(f"('{n}')" for n in sorted({*C.ALIASES.values(), *(name for name, _ in C.RULES)}))
_RAW = "coalesce(" + ", ".join("nullif(regexp_extract(attributes, '{}', 1), '')".format(p.replace("'", "''")) for p in C.ATTRIBUTES) + ")"


@query("code_language_infer", f"WITH c AS (SELECT o_orderkey, regexp_replace(code, '^\\s+|\\s+$', '', 'g') AS s FROM ({same(CODES)})) SELECT o_orderkey, {C.inferred_sql('s')} AS language FROM c")
def code_language_infer(spark, sf_dir):
    return derived(spark, sf_dir, CODES).select("o_orderkey", C.inferred(F.col("code")).alias("language"))


@query("code_language_alias", f"""
    WITH b AS (SELECT o_orderkey, lower(regexp_replace({_RAW}, '^\\s+|\\s+$', '', 'g')) AS raw FROM ({same(BLOCKS)}))
    SELECT o_orderkey, coalesce(a.language, i.language) AS language FROM b LEFT JOIN (VALUES {_VALUES}) a(alias, language) ON raw = a.alias LEFT JOIN (VALUES {_KNOWN}) i(language) ON raw = i.language""")  # fmt: skip
def code_language_alias(spark, sf_dir):
    return C.named(derived(spark, sf_dir, BLOCKS), C.alias_rows(spark), C.language_rows(spark)).select("o_orderkey", "language")
