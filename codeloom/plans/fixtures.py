"""Code-graph relations derived from the driver's tables.

Each relation is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table or an
earlier relation.  Operators get them as DataFrames, oracle queries as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import kept

#: Shapes of source paths; @ is the part's number.
PATHS = (
    "manage.py", "apps/a@/src/main.ts", "tools/t@/src/index.tsx", "main.py", "web/w@/src/server.ts", "site/s@/src/pages/_app.tsx", "site/s@/src/app/layout.tsx", "packages/p@/index.js",
    "stories/b@.ts", "tests/t@.py", "lib/x@.test.ts", "src/pages/p@.tsx", "src/app/a@/page.tsx", "src/user-page/u@.js", "node_modules/m@/i.js", "generated/g@.ts", "domain/ports/p@.py", "domain/d@.py",
    "svc/adapters/in/a@.py", "svc/adapters/out/o@.py", "application/u@.py", "persistence/r@.mts", "infra/repositories/r@.py", "config/c@.fsx", "middleware/m@.rb", "controllers/c@.kts", "core/c@.go", "lib/util_test.py", "core/spec.x@.php", "docs/d@.txt",
)

#: Shapes of source lines; @a and @b are names.
SCRIPT_LINES = ("import @a from './m'", "const @a = 1", "function @a(@b)", "(@a, @b) => 0", "catch (@a)", "@a = 2", "@a == 2", "@a()", "// const @a", "let [ @a, @b ] = x", "class @a extends @b", "@a => @b", "constant @a", "x = '//' + @a", "var @a")
PYTHON_LINES = ("import @a", "from m import @a, @b", "def @a(@b, x):", "async def f(@a):", "class @a(@b):", "for @a, @b in xs:", "with @a as @b:", "except E as @a:", "@a = 1", "@a == @b", "@a != @b", "@a: int", "@a(@b)", "@a, @b = f()", "return @a <= @b")

RELATIONS: dict[str, str] = {
    "fx_lines": """
        select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as ord
        from {lineitem}""",
    "fx_edges": """
        select concat('e:', l_orderkey, ':', ord) as id,
          case when l_quantity >= 48 then 'calls' when l_quantity >= 44 then 'imports' when l_quantity >= 40 then 'exports' when l_quantity >= 34 then 'routesTo' when l_quantity >= 28 then 'usesModel'
            when l_quantity >= 22 then 'renders' when l_quantity >= 16 then 'injects' when l_quantity >= 10 then 'extends' else 'configures' end as kind,
          concat('part:', src) as source_id,
          case when l_tax >= 0.08 then concat('missing:', l_partkey) when l_discount >= 0.10 then concat('ext:', l_suppkey) else concat('part:', l_partkey) end as target_id,
          case when l_tax >= 0.08 then 'unresolved' when l_returnflag = 'A' then 'exact' when l_returnflag = 'N' then 'resolved' when l_linestatus = 'F' then 'inferred' else 'unresolved' end as confidence,
          cast(l_orderkey % 1000 as int) as start_line,
          case when ord % 3 = 0 then concat(' call', l_partkey, ' ') else '  ' end as call_name, case when ord % 3 = 1 then concat('x.', l_suppkey) end as call_expression
        from (select *, lag(l_partkey) over (partition by l_orderkey order by ord) as src from {fx_lines}) t where src is not null""",
    "fx_call_edges": "select * from {fx_edges} where kind = 'calls'",
    "fx_parts": """
        select concat('part:', p_partkey) as id, case p_size % 3 when 0 then 'function' when 1 then 'method' else 'constructor' end as kind, p_name as name, concat(p_brand, '.', p_name) as qualified_name,
          concat('/ws/', lower(p_type), '/', replace(lower(p_brand), '#', ''), '/p', p_partkey % 17, '.py') as file_path, cast(p_partkey % 400 as int) * 10 as start_line, cast(p_partkey % 400 as int) * 10 + 8 as end_line
        from {part}""",
    "fx_nodes": """
        select id, kind, name, qualified_name, file_path, start_line, end_line from {fx_parts}
        union all select concat('ext:', s_suppkey), 'external', s_name, s_name, '', 0, 0 from {supplier}
        union all select distinct concat('file:', file_path), 'file', file_path, file_path, file_path, 0, 4000 from {fx_parts}""",
    "fx_units": """
        select concat('unit:', c_custkey) as id, case c_custkey % 3 when 0 then 'FastAPI' when 1 then 'Django' else 'Express' end as framework,
          case c_custkey % 6 when 0 then 'route' when 1 then 'operation' when 2 then 'controller' when 3 then 'service' when 4 then 'repository' else 'model' end as kind,
          concat('unit ', c_custkey) as name, p.file_path, p.start_line as start_line, p.start_line + 8 + cast(c_custkey % 3 as int) * 10 as end_line
        from {customer} join {fx_parts} p on p.id = concat('part:', c_custkey)""",
    "fx_boundaries": """
        select distinct concat('/ws/', lower(p_type)) as root_key, 'frameworkRoot' as basis from {part}
        union all select distinct concat('/ws/', lower(p_type), '/', replace(lower(p_brand), '#', '')), 'workspacePackage' from {part} where length(p_brand) = 8
        union all select '/ws', 'workspaceRoot'""",
    "fx_blocks": """
        select l_orderkey as function_id, ord as block_id, case when l_returnflag = 'A' then 'define' else 'read' end as access, l_partkey % 2 as binding from {fx_lines}""",
    "fx_block_edges": """
        select function_id, block_id as src, block_id + 1 as dst, 'next' as kind from {fx_blocks} b where exists (select 1 from {fx_blocks} c where c.function_id = b.function_id and c.block_id = b.block_id + 1)
        union all select l_orderkey, ord, 1, 'repeat' from {fx_lines} where ord > 1 and l_returnflag = 'R'""",
    "fx_unit_edges": """
        select concat('ue:', c_custkey, ':', k) as id, 'routesTo' as kind, concat('unit:', c_custkey) as source_id, concat('unit:', c_custkey + k) as target_id,
          split_part('exact;resolved;inferred;unresolved', ';', cast((c_custkey + k) % 4 as int) + 1) as confidence
        from {customer}, (select 3 as k union all select 4 union all select 9) t where c_custkey % 6 < 2 and c_custkey % 5 <> 1""",
    "fx_part_files": f"""
        select concat('part:', p_partkey) as id, replace(split_part('{";".join(PATHS)}', ';', cast(p_partkey % {len(PATHS)} as int) + 1), '@', cast(p_partkey as string)) as path from {{part}}""",
    "fx_files": "select distinct path from {fx_part_files}",
    "fx_imports": """
        select s.path as source, coalesce(t.path, e.target_id) as target
        from {fx_edges} e join {fx_part_files} s on s.id = e.source_id left join {fx_part_files} t on t.id = e.target_id where e.kind in ('imports', 'exports') and s.path <> coalesce(t.path, '')""",
    "fx_conditions": """
        select l_orderkey as function_id, l_orderkey % 7 as group_id, ord as block_id, ord - 1 as member_index, l_returnflag as flag, count(*) over (partition by l_orderkey) as n from {fx_lines}""",
    "fx_condition_edges": """
        select function_id, block_id * 2 as edge_id, block_id as src, case when block_id < n then block_id + 1 else 100 end as dst, 'true' as kind from {fx_conditions}
        union all select function_id, block_id * 2 + 1, block_id, case when flag <> 'A' and block_id < n then block_id + 1 else 200 end, 'false' from {fx_conditions}""",
    "fx_code": """
        select *, cast(floor(l_orderkey / 64) as bigint) as k, concat('n', l_partkey % 997) as a, concat('n', l_suppkey % 97) as b from {fx_lines}""",
    "fx_code_lines": f"""
        select concat('c', k, case k % 2 when 0 then '.ts' else '.py' end) as path, case k % 2 when 0 then 'typescript' else 'python' end as language,
          row_number() over (partition by k order by l_orderkey, ord) as line,
          replace(replace(case k % 2 when 0 then split_part('{";".join(x.replace("'", "''") for x in SCRIPT_LINES)}', ';', cast(l_linenumber * 7 + l_partkey as int) % {len(SCRIPT_LINES)} + 1)
            else split_part('{";".join(PYTHON_LINES)}', ';', cast(l_linenumber * 7 + l_partkey as int) % {len(PYTHON_LINES)} + 1) end, '@a', a), '@b', b) as code
        from {{fx_code}}""",
    "fx_named_imports": """
        select concat('c', x.k, case x.k % 2 when 0 then '.ts' else '.py' end) as path, -cast(x.l_orderkey as int) as import_line, x.a as local_name, concat('c', y.k, case y.k % 2 when 0 then '.ts' else '.py' end) as target_path, y.a as imported_name
        from {fx_code} x join {fx_code} y on y.l_orderkey = x.l_orderkey + 128 and y.ord = 3 where x.ord = 2""",
    "fx_code_nodes": """
        select concat('file:', path) as id, 'file' as kind, path as name, path as qualified_name, path as file_path, '' as parent_id from (select distinct path from {fx_code_lines}) t
        union all select concat('fn:', l_orderkey, ':', ord), case when l_returnflag = 'A' then 'method' else 'function' end, a, case when l_linestatus = 'F' and l_discount > 0.08 then concat('C.', a) else a end, concat('c', k, case k % 2 when 0 then '.ts' else '.py' end),
          case when l_tax < 0.07 then concat('file:c', k, case k % 2 when 0 then '.ts' else '.py' end) else 'cls' end from {fx_code} where ord = 3
        union all select concat('caller:', l_orderkey), 'function', 'caller', 'caller', concat('c', k, case k % 2 when 0 then '.ts' else '.py' end), 'cls' from {fx_code} where ord = 2
        union all select distinct concat('x:', a), 'external', a, case when a in ('n5', 'n6') then concat('q.', a) else a end, '', '' from {fx_code}""",
    "fx_code_edges": """
        select concat('ce:', l_orderkey) as id, 'calls' as kind, concat('caller:', l_orderkey) as source_id, concat('x:', a) as target_id, case when l_tax > 0.07 then 'exact' else 'unresolved' end as confidence,
          concat('c', case when l_discount = 0.05 then k + 1 else k end, case k % 2 when 0 then '.ts' else '.py' end) as file_path from {fx_code} where ord = 2""",
    "fx_scoped_symbols": """
        select concat('y:', l_orderkey, ':', ord) as id, concat('d', l_orderkey % 4001) as file_path, split_part('function;method;class;constructor', ';', cast(l_suppkey % 4 as int) + 1) as kind, qualified_name, regexp_replace(qualified_name, '^.*[.]', '') as name, l_orderkey * 10 + ord as ord
        from (select *, split_part('f;A.f;A.B.f;g;A.g;B.g;h;A.B.h;self.f;B.A.f;k;m', ';', cast(l_partkey % 12 as int) + 1) as qualified_name from {fx_lines}) t""",
    "fx_scoped_calls": """
        select concat('z:', l_orderkey, ':', ord) as call_id, concat('d', l_orderkey % 4001) as file_path, case l_orderkey % 4001 % 3 when 0 then 'python' when 1 then 'typescript' else 'javascript' end as language, concat('src:', l_orderkey % 4001, ':', l_suppkey % 5) as source_id,
          split_part('A.B.f,A.f,f,A.B.h.x,,A.g,B', ',', cast(l_partkey % 7 as int) + 1) as scope, nullif(split_part(';;;this;self;cls;A;B;A.B', ';', cast(l_suppkey % 9 as int) + 1), '') as qualifier, split_part('f;g;h;k;m;zz', ';', cast(ord + l_quantity as int) % 6 + 1) as name
        from {fx_lines}""",
    "fx_lexical": "select distinct source_id, name from (select concat('src:', l_orderkey % 4001, ':', l_suppkey % 5) as source_id, split_part('f;g;h;k', ';', cast(l_partkey % 4 as int) + 1) as name from {fx_lines} where l_discount = 0.01) t",
    "fx_sites": """
        select concat('fn', cast(floor(l_orderkey / 16) as bigint)) as function_id, concat('site:', l_orderkey, ':', ord) as site_id, concat('p', cast(floor(l_orderkey / 16) as bigint) % 7) as file_path, split_part('f;g;h;k', ';', cast(l_partkey % 4 as int) + 1) as callee_name,
          cast(l_suppkey % 12 as int) as start_line, cast(l_partkey % 9 as int) as start_character, cast(l_suppkey % 12 + ord % 3 as int) as end_line, 9 as end_character from {fx_lines} where ord % 2 = 1""",
    "fx_site_targets": "select concat('t', k) as id, split_part('f;g;h;k;f;z', ';', k + 1) as name, split_part('f;A.g;h;B.k;A.h;B.C.f', ';', k + 1) as qualified_name from (select cast(p_partkey as int) as k from {part} where p_partkey between 0 and 5) t",
    "fx_site_edges": """
        select concat('edge:', l_orderkey, ':', ord) as id, concat('fn', cast(floor(l_orderkey / 16) as bigint)) as source_id, concat('t', l_suppkey % 7) as target_id, concat('p', cast(floor(l_orderkey / 16) as bigint) % 7) as file_path,
          cast(l_partkey % 13 as int) as start_line, cast(l_suppkey % 10 as int) as start_character, cast(l_partkey % 13 as int) as end_line, cast(l_suppkey % 10 + 3 as int) as end_character from {fx_lines} where ord % 2 = 0""",
    "fx_scopes": """
        select *, cast(floor((block + 1) / 3) as bigint) as around, case when block = 1 then 0 else cast(floor((block + 1) / 3) as bigint) * 2 + slot end as container,
          case when kind_of < 5 then split_part('condition;loop;switch;try;loop', ';', kind_of + 1) end as control, case when block_kind > 6 then 'statement' else split_part('return;throw;break;continue;break;statement;statement', ';', block_kind + 1) end as kind
        from (select cast(floor(l_orderkey / 24) as bigint) as function_id, row_number() over (partition by cast(floor(l_orderkey / 24) as bigint) order by l_orderkey, ord) as block, cast(l_quantity as int) % 2 as slot, cast(l_partkey % 7 as int) as kind_of, cast(l_suppkey % 11 as int) as block_kind, l_suppkey % 3 as s3 from {fx_lines}) t""",
    "fx_logic_blocks": "select function_id, block, container, block as ord, coalesce(control, kind) as kind from {fx_scopes}",
    "fx_logic_containers": """
        select function_id, cast(0 as bigint) as container, cast(null as bigint) as owner, 'root' as role from {fx_scopes} where block = 1
        union all select distinct b.function_id, b.container, b.around, case when o.control = 'loop' and b.slot = 0 then 'loopBody' when o.control = 'try' and b.slot = 1 and o.s3 > 0 then 'finally' else 'branch' end
        from {fx_scopes} b join {fx_scopes} o on o.function_id = b.function_id and o.block = b.around where b.block > 1""",
    "fx_logic_controls": "select function_id, block, control as kind, case when block_kind = 10 then 'inferred' end as confidence, case when control = 'try' and s3 > 0 then block * 2 + 1 end as final, s3 = 0 as has_default from {fx_scopes} where control is not null",
    "fx_logic_branches": """
        select function_id, block, cast(slot2 as bigint) as ord, block * 2 + slot2 as container, case control when 'condition' then (case slot2 when 0 then 'true' else 'false' end) when 'loop' then (case slot2 when 0 then 'body' else 'exit' end) when 'switch' then 'case' else (case when slot2 = 0 then 'next' when s3 > 0 then 'finally' else 'exception' end) end as kind,
          concat('branch ', slot2) as label from {fx_scopes}, (select 0 as slot2 union all select 1) t where control is not null and (slot2 = 0 or s3 > 0 or control in ('switch', 'try'))""",
    "fx_module_files": """
        select concat(case when p_partkey % 29 = 0 then '/other/' else '/ws/' end, split_part('app;src;lib;Services;core;tools;packages;docs', ';', cast(p_partkey % 8 as int) + 1), case when p_partkey % 5 = 0 then '' else concat('/', replace(lower(p_brand), '#', '')) end, case when p_partkey % 3 = 0 then concat('/', split_part(lower(p_type), ' ', 1)) else '' end, '/m', p_partkey % 17, '.py') as file_path from {part}
        union all select concat('/ws/top', p_partkey % 3, '.py') from {part}""",
    "fx_packages": "select distinct concat('/ws/', split_part('src;core;tools;packages', ';', cast(s_suppkey % 4 as int) + 1), '/brand', s_suppkey % 40) as root_path, split_part('package.json;pyproject.toml;go.mod', ';', cast(s_suppkey % 3 as int) + 1) as manifest, split_part('npm;python;go', ';', cast(s_suppkey % 3 as int) + 1) as ecosystem from {supplier}",
    "fx_explicit_roots": """
        select concat('/', case when n_nationkey % 6 = 0 then 'else' else 'ws' end, '/', split_part('src;docs;lib', ';', cast(n_nationkey % 3 as int) + 1), '/brand', n_nationkey) as root_path, case when n_nationkey % 2 = 0 then n_name else ' ' end as name, split_part('workspacePackage;frameworkRoot;sourceArea', ';', cast(n_nationkey % 3 as int) + 1) as basis,
          case when n_nationkey % 4 = 0 then 'inferred' end as confidence, case when n_nationkey % 5 = 0 then concat('chosen ', n_nationkey) end as label, case when n_nationkey % 3 = 1 then 'Next.js' else '' end as framework from {nation}""",
    "fx_found_frameworks": "select split_part('React;Django;FastAPI', ';', cast(r_regionkey % 3 as int) + 1) as name, case when r_regionkey % 2 = 0 then concat('/ws/app/brand1', r_regionkey) end as root_path from {region}",
    "fx_unit_roots": "select distinct split_part('FastAPI;Django;Express', ';', cast(c_custkey % 3 as int) + 1) as framework, split_part('route;model', ';', cast(c_custkey % 2 as int) + 1) as kind, concat('/ws/lib/brand', c_custkey % 60) as root_path from {customer}",
    "fx_flow_rows": """
        select *, cast(floor(l_orderkey / 4) as bigint) as flow, row_number() over (partition by cast(floor(l_orderkey / 4) as bigint) order by l_orderkey, ord) as k from {fx_lines}""",
    "fx_flow_steps": """
        select concat('flow', flow) as flow_id, concat('s', k) as step_id, case when k = 1 then (case when l_suppkey % 2 = 0 then 'route' else 'operation' end) when k = 2 or k = 3 and l_suppkey % 5 = 0 then 'handler' else 'call' end as kind, cast(case when k < 3 then k - 1 else floor(k / 3) + 1 end as bigint) as depth,
          case when k > 2 then nullif(split_part('repository;model;external;sideEffect;;;;;;', ';', cast(l_partkey % 10 as int) + 1), '') end as role, split_part('concrete;concrete;concrete;external;concrete;unresolved;concrete', ';', cast(l_quantity as int) % 7 + 1) as resolution,
          case when k = 1 or l_tax = 0.08 then null else concat('f', flow, ':', k) end as function_id,
          case when k < 3 then null when l_suppkey % 13 = 0 then concat('f', flow, ':', k + 1) when k = 3 or l_partkey % 3 > 0 then concat('f', flow, ':', 2 + cast(floor((k - 3) / 2) as bigint)) else concat('f', flow, ':', k - 1) end as parent_function_id,
          split_part('exact;resolved;inferred;unresolved', ';', cast(l_suppkey % 4 as int) + 1) as confidence, concat('/ws/p', l_partkey % 3) as file_path, case when l_discount > 0.01 then cast(l_partkey % 40 as int) end as start_line, cast(l_suppkey % 9 as int) as start_character, case when k = 1 then 'u1' end as unit_id, case when k > 2 then concat('e', k) end as edge_id
        from {fx_flow_rows}""",
    "fx_flow_assessed": """
        select concat('f', flow, ':', k) as function_id, split_part('domain;application;dataAccess;unclassified;unclassified;unclassified', ';', cast(l_partkey % 6 as int) + 1) as layer, split_part('high;medium;low;unknown', ';', cast(l_suppkey % 4 as int) + 1) as sureness,
          split_part('domainRuleCandidate;applicationWorkflowCandidate;notBusinessLogic;unknown;unknown;unknown', ';', case when flow % 3 > 0 then 3 + cast(l_partkey % 3 as int) else cast(l_partkey % 6 as int) end + 1) as business, l_suppkey % 7 = 0 as conflicted from {fx_flow_rows} where l_partkey % 4 > 0 and k > 1""",
    "fx_reading_flows": """
        select concat('flow', flow) as flow_id, concat('scope', flow % 40) as scope_id, l_partkey % 6 > 0 as mapped, split_part('exact;resolved;inferred;unresolved', ';', cast(l_suppkey % 4 as int) + 1) as confidence, l_partkey % 11 = 0 as depth_limit, l_suppkey % 17 = 0 as step_limit from {fx_flow_rows} where k = 1""",
    "fx_manifest_files": """
        select concat('/ws/g', s_suppkey % 9, '/s', s_suppkey, '/', name) as path, case name
          when 'package.json' then concat(chr(123), '"name":"x","dependencies":', chr(123), '"', dep, '":"1","left-pad":"2"', chr(125), ',"devDependencies":', chr(123), '"', dev, '":"3"', chr(125), ',"scripts":', chr(123), '"build":"', lower(script), ' build && x-next","test":"echo NEXT.js"', chr(125), chr(125))
          when 'composer.json' then concat(chr(123), '"require":', chr(123), '"php":"8","', php, '":"1"', chr(125), ',"require-dev":', chr(123), '"symfony/symfony":"2"', chr(125), chr(125))
          when 'requirements.txt' then concat('# Flask', chr(10), '-r other.txt', chr(10), py, '[extra]>=3 # why', chr(10), 'git+https://x/fastapi', chr(10), 'Py_Other==1')
          when 'pyproject.toml' then concat('[project]', chr(10), 'dependencies = ["', py, '>=1", "x"]', chr(10), '# "django"', chr(10), 'pytest = "*"', chr(10), 'note = 1')
          when 'Cargo.toml' then concat('[package]', chr(10), 'axum = "no"', chr(10), '[', sec, ']', chr(10), '"', crate, '" = "1"', chr(10), 'serde = "1"', chr(10), '[features]', chr(10), 'rocket = []', chr(10), '[target.x.dependencies.tauri]')
          when 'go.mod' then concat('module github.com/gin-gonic/gin', chr(10), 'require (', chr(10), '  ', gomod, '/v4 v1 // github.com/gofiber/fiber', chr(10), ')', chr(10), 'exclude github.com/gofiber/fiber v1', chr(10), 'require github.com/other/x v2')
          when 'pom.xml' then concat('<a>', case when s_suppkey % 2 = 0 then 'org.springframework.boot' else 'spring-boot' end, '-x</a>', case when s_suppkey % 3 = 0 then 'spring-boot-starter-web' else '' end)
          when 'Gemfile' then concat('# gem "rails"', chr(10), case when s_suppkey % 2 = 0 then concat('  gem ', chr(39), 'rails', chr(39), ', "7"') else 'gemspec "rails"' end)
          when 'manage.py' then concat('import os', chr(10), case when s_suppkey % 5 > 0 then 'DJANGO_SETTINGS_MODULE' else '' end, chr(10), case when s_suppkey % 2 = 0 then 'from django.core.management import x' else 'execute_from_command_line()' end)
          else 'nothing' end as content
        from (select s_suppkey, split_part('package.json;composer.json;requirements.txt;pyproject.toml;Cargo.toml;go.mod;pom.xml;Gemfile;manage.py;notes.txt', ';', cast((s_suppkey + k) % 10 as int) + 1) as name, split_part('react;next;vue;@nestjs/core;vite;graphql;lodash', ';', cast(s_suppkey % 7 as int) + 1) as dep,
          split_part('jest;vitest;eslint;express', ';', cast(s_suppkey % 4 as int) + 1) as dev, split_part('react-scripts;Next;ng;nest;vite', ';', cast(s_suppkey % 5 as int) + 1) as script, split_part('laravel/framework;symfony/framework-bundle;x/y', ';', cast(s_suppkey % 3 as int) + 1) as php,
          split_part('Django;flask;fastapi;Strawberry_GraphQL;graphene;numpy', ';', cast(s_suppkey % 6 as int) + 1) as py, split_part('dependencies;dev-dependencies;build-dependencies;workspace.dependencies;lib', ';', cast(s_suppkey % 5 as int) + 1) as sec,
          split_part('axum;actix-web;rocket;libc', ';', cast(s_suppkey % 4 as int) + 1) as crate, split_part('github.com/labstack/echo;github.com/labstack/echoes;github.com/gofiber/fiber', ';', cast(s_suppkey % 3 as int) + 1) as gomod from {supplier}, (select 0 as k union all select 3 union all select 7) t) u
        union all select concat('/ws/g', s_suppkey % 9, '/requirements.txt'), 'django' from {supplier} where s_suppkey < 9""",
    "fx_brief_flows": """
        select concat('entry:', c_custkey) as entry_id, split_part('FastAPI;Django;Express', ';', cast(c_custkey % 3 as int) + 1) as framework, concat('/ws/r', c_custkey % 4) as root_path, case when c_custkey % 5 < 2 then 'route' else 'operation' end as entry_kind,
          concat(split_part('Query;Mutation;Subscription;query;Type', ';', cast(c_custkey % 7 as int) % 5 + 1), '.f', c_custkey) as qualified_name, split_part('mapped;ambiguous;handlerNotMapped;mapped', ';', cast(c_nationkey % 4 as int) + 1) as status, concat('scope', c_custkey % 6) as scope_id from {customer}""",
    "fx_summary_blocks": "select function_id, block, case when kind = 'statement' then split_part('call;effect;mutation;statement', ';', cast(block % 4 as int) + 1) else kind end as kind, cast(block % 3 as int) as value_changes from {fx_logic_blocks}",
    "fx_choice_blocks": "select function_id, block_id, case when block_id = 1 then 'entry' else 'block' end as kind from {fx_conditions} union all select distinct function_id, cast(100 as int), 'block' from {fx_conditions} union all select distinct function_id, cast(200 as int), 'block' from {fx_conditions}",
    "fx_choices": "select function_id, block_id, block_id * 2 + case when flag = 'R' then 1 when function_id % 5 = 0 then 7 else 0 end as edge_id from {fx_conditions} where flag <> 'A' or function_id % 3 = 0",
    "fx_view_edges": """
        select id, kind, source_id, target_id from {fx_edges} where kind not in ('imports', 'exports')
        union all select concat('v:', e.id), e.kind, concat('file:', s.file_path), case when t.id is null then e.target_id else concat('file:', t.file_path) end from {fx_edges} e join {fx_parts} s on s.id = e.source_id left join {fx_parts} t on t.id = e.target_id where e.kind in ('imports', 'exports')
        union all select concat('c:', id), 'contains', concat('file:', file_path), id from {fx_parts}""",
    "fx_places": """
        select target_id, case when start_line % 7 = 0 then '' else concat('/ws/p', start_line % 5) end as file_path, case when start_line % 3 > 0 then start_line end as start_line, case when start_line % 3 > 0 then start_line % 11 end as start_character, case when start_line % 3 > 0 then start_line + 1 end as end_line, 0 as end_character from {fx_call_edges}""",
    "fx_spans": """
        select function_id, block as block_id, case when block = 1 then 'entry' else kind end as kind, cast(floor(block / 4) as int) as depth, block as ord, block % 40 as first, block % 40 + 3 + block % 9 as last from {fx_logic_blocks}""",
    "fx_points": "select function_id, concat(function_id, ':', block) as point_id, block % 37 + 2 as first, block % 37 + 2 + block % 3 as last from {fx_logic_blocks}",
    "fx_diagnostics": """
        select event_id as id, split_part('parser.failure;file.skipped;analysis.slow;Syntax.Error;excluded.dir', ';', cast(event_id % 5 as int) + 1) as code, split_part('cannot Parse it;was excluded by a rule;took long;fine', ';', cast(event_id % 4 as int) + 1) as message,
          split_part('error;warning;information', ';', cast(event_id % 3 as int) + 1) as severity, case when user_id % 4 = 0 then '' else concat('/ws/f', user_id % 50, '.py') end as file_path
        from {events}""",
}
_NAME = re.compile(r"\{(\w+)\}")


class Graph:
    """The tables and relations of one folder, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            text = RELATIONS.get(name)
            if text is None:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._known[name] = self.spark.sql(text, **{n: self[n] for n in set(_NAME.findall(text))})
        return self._known[name]

    def keep(self, name: str, *columns: str) -> None:
        """Works these columns of a relation out once, for all relations over it that are asked for later."""
        self._known[name] = kept(self[name].select(*columns), clear=True)

    nodes = property(lambda self: self["fx_nodes"])
    edges = property(lambda self: self["fx_call_edges"])


def oracle(*relations: str, query: str) -> str:
    """``query`` after the common table expressions of the relations that it and they need."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in RELATIONS and name not in needed:
            for inner in _NAME.findall(RELATIONS[name]):
                visit(inner)
            needed.append(name)

    for r in relations:
        visit(r)
    ctes = [f"{n} as ({_NAME.sub(r'\1', RELATIONS[n])})" for n in needed]
    body = query.strip()
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(ctes) + ", " + body[14:]
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body
