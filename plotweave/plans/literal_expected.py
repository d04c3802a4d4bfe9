"""The rows that the queries on literal inputs must give, stated as SQL. They were taken from the queries' results and read against the operators' rules, so they guard
against changes; they aren't an independent computation."""

# The expected rows.
EXPECTED = {
    "validator_issues": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(severity AS VARCHAR) AS severity, CAST(category AS VARCHAR) AS category, CAST(n AS BIGINT) AS n FROM (VALUES
 ('collision', 'error', 'collision', 2), ('far', 'warning', 'lone_underground', 2), ('ground', 'warning', 'inserter_ground', 1), ('head_on', 'warning', 'belt_head_on', 2),
 ('islands', 'warning', 'pole_islands', 1), ('lone', 'warning', 'lone_underground', 1), ('no_poles', 'warning', 'no_poles', 1), ('off', 'error', 'off_grid', 1),
 ('pump', 'error', 'collision', 1), ('target', 'error', 'inserter_target', 1), ('unknown', 'error', 'unparseable', 1), ('unpowered', 'warning', 'belt_end', 1),
 ('unpowered', 'warning', 'unpowered', 1)) AS t(layout_id, severity, category, n)""",
    "final_products": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(item AS VARCHAR) AS item FROM (VALUES
 ('circuits', 'electronic-circuit'), ('mixed', 'belt'), ('mixed', 'inserter'), ('ore', 'iron-plate')) AS t(layout_id, item)""",
    "recipe_shape_rank": """SELECT CAST(recipe AS VARCHAR) AS recipe, CAST(distance AS BIGINT) AS distance FROM (VALUES
 ('belt', 0), ('copper-cable', 1), ('engine-unit', 1), ('iron-gear-wheel', 1), ('iron-plate', 1)) AS t(recipe, distance)""",
    "recipe_tables": """SELECT CAST(what AS VARCHAR) AS what, CAST(name AS VARCHAR) AS name, CAST(value AS VARCHAR) AS value FROM (VALUES
 ('barrel', 'empty-water-barrel', 'in:water-barrel out:barrel out:water'), ('barrel', 'water-barrel', 'in:barrel in:water out:water-barrel'), ('changed', 'concrete', ''),
 ('changed', 'plastic-bar', ''), ('family', 'belt', 'assembly_2in'), ('family', 'concrete', 'assembly_fluid'), ('family', 'copper-cable', 'assembly_1in'),
 ('family', 'electronic-circuit', 'assembly_2in'), ('family', 'engine-unit', 'assembly_3in'), ('family', 'inserter', 'assembly_3in'),
 ('family', 'iron-gear-wheel', 'assembly_1in'), ('family', 'iron-plate', 'assembly_1in'), ('family', 'plastic-bar', 'chemistry'), ('family', 'steel-plate', 'assembly_1in'),
 ('smelts', 'iron-ore', 'iron-plate'), ('smelts', 'iron-plate', 'steel-plate')) AS t(what, name, value)""",
    "classify_layouts": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(category AS VARCHAR) AS category FROM (VALUES
 ('belts', NULL), ('circuits', 'green_circuits'), ('gears', 'assembly_1in'), ('labs', 'labs'), ('mall', NULL), ('mixed_purpose', NULL), ('nuclear', 'nuclear'),
 ('ore', 'mining'), ('plastics', 'plastic'), ('pump_station', NULL), ('smelter', NULL), ('solar', 'solar'), ('steam', 'steam'), ('turret_and_factory', 'assembly_1in'),
 ('two_products', 'multi'), ('wall', 'defense')) AS t(layout_id, category)""",
    "build_segments": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(name AS VARCHAR) AS name, CAST(n AS BIGINT) AS n, CAST(first_x AS INTEGER) AS first_x, CAST(last_x AS INTEGER) AS last_x FROM (VALUES
 ('rowx1', 'inserter', 2, 0, 0), ('rowx1', 'splitter', 1, -1, -1), ('rowx1', 'stone-furnace', 1, 0, 0), ('rowx1', 'transport-belt', 5, 0, 2), ('rowx4', 'inserter', 8, 0, 6),
 ('rowx4', 'splitter', 1, -1, -1), ('rowx4', 'stone-furnace', 4, 0, 6), ('rowx4', 'transport-belt', 17, 0, 8)) AS t(layout_id, name, n, first_x, last_x)""",
    "design_facts": """SELECT CAST(design AS VARCHAR) AS design, CAST(machines AS BIGINT) AS machines, CAST(height AS INTEGER) AS height, CAST(tiles_per_machine AS DOUBLE) AS tiles_per_machine, CAST(beacons_per_machine AS DOUBLE) AS beacons_per_machine, CAST(belt_tier AS VARCHAR) AS belt_tier, CAST(head_entities AS BIGINT) AS head_entities, CAST(tail_entities AS BIGINT) AS tail_entities, CAST(machine AS VARCHAR) AS machine, CAST(pitch AS VARCHAR) AS pitch, CAST(poles AS VARCHAR) AS poles, CAST(chain AS BOOLEAN) AS chain FROM (VALUES
 ('row', 1, 6, 12.0, 0.0, 'yellow', 1, 1, 'stone-furnace', 'tight', 'none', false)) AS t(design, machines, height, tiles_per_machine, beacons_per_machine, belt_tier, head_entities, tail_entities, machine, pitch, poles, chain)""",
    "belt_weaving": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(names AS VARCHAR) AS names, CAST(woven AS BOOLEAN) AS woven FROM (VALUES
 ('crossing', 'underground-belt underground-belt underground-belt', false), ('long', 'express-underground-belt express-underground-belt transport-belt', false),
 ('plain', 'underground-belt underground-belt', false), ('woven', 'underground-belt fast-underground-belt underground-belt fast-underground-belt transport-belt', true)) AS t(layout_id, names, woven)""",
    "lifted_forms": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(form AS VARCHAR) AS form, CAST(name AS VARCHAR) AS name, CAST(direction AS INTEGER) AS direction, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST("count" AS INTEGER) AS "count", CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(status AS VARCHAR) AS status FROM (VALUES
 ('column', 'label', 'constant-combinator', 0, 5, 5, 1, 0, 0, 'ok'), ('column', 'row', 'stone-wall', 0, 0, 0, 4, 0, 3, 'ok'),
 ('mixed', 'belt_line', 'transport-belt', 12, 4, 2, 4, -1, 0, 'ok'), ('mixed', 'belt_line', 'transport-belt', 4, 0, 0, 5, 1, 0, 'ok'),
 ('mixed', 'pair', 'underground-belt', 4, 0, 8, 1, 3, 0, 'ok'), ('mixed', 'row', 'pipe', 0, 0, 5, 4, 2, 0, 'ok'), ('mixed', 'single', 'lab', 0, 9, 9, 1, 0, 0, 'ok')) AS t(layout_id, form, name, direction, x, y, "count", dx, dy, status)""",
    "extracted_designs": """SELECT CAST(design AS VARCHAR) AS design, CAST(part AS VARCHAR) AS part, CAST(name AS VARCHAR) AS name, CAST(n AS BIGINT) AS n, CAST(period AS INTEGER) AS period, CAST(repeats AS INTEGER) AS repeats FROM (VALUES
 ('row', 'head', 'pipe', 1, 4, 4), ('row', 'segment', 'inserter', 2, 4, 4), ('row', 'segment', 'stone-furnace', 1, 4, 4), ('row', 'segment', 'transport-belt', 8, 4, 4),
 ('row', 'tail', 'transport-belt', 2, 4, 4)) AS t(design, part, name, n, period, repeats)""",
    "simulate_lanes": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(node AS VARCHAR) AS node, CAST(item AS VARCHAR) AS item FROM (VALUES
 ('gears', 'b:0:0', 'iron-plate'), ('gears', 'b:0:1', 'coal'), ('gears', 'b:1:0', 'iron-plate'), ('gears', 'b:1:1', 'coal'), ('gears', 'b:2:0', 'iron-plate'),
 ('gears', 'b:2:1', 'coal'), ('gears', 'b:5:1', 'iron-gear-wheel'), ('gears', 'b:6:1', 'iron-gear-wheel'), ('gears', 'i:3', 'iron-plate'),
 ('gears', 'o:3', 'iron-gear-wheel'), ('side', 'b:0:0', 'coal'), ('side', 'b:1:0', 'coal'), ('side', 'b:1:0', 'stone'), ('side', 'b:1:0', 'wood'), ('side', 'b:2:0', 'coal'),
 ('side', 'b:2:0', 'stone'), ('side', 'b:2:0', 'wood'), ('side', 'b:3:0', 'stone'), ('side', 'b:3:1', 'wood')) AS t(layout_id, node, item)""",
    "verdict": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(problem AS VARCHAR) AS problem, CAST(node AS VARCHAR) AS node, CAST(item AS VARCHAR) AS item FROM (VALUES
 ('side', 'lane_mixed', 'b:1', 'coal'), ('side', 'lane_mixed', 'b:2', 'coal'), ('side', 'starved', 'i:4', 'copper-cable'), ('side', 'starved', 'i:4', 'iron-plate')) AS t(layout_id, problem, node, item)""",
    "parsed_settings": """SELECT CAST(idx AS INTEGER) AS idx, CAST(name AS VARCHAR) AS name, CAST(settings AS VARCHAR) AS settings, CAST(reject AS VARCHAR) AS reject FROM (VALUES
 (0, 'assembling-machine-2', 'modules:speed-module=2 recipe:iron-gear-wheel', ''), (1, 'assembling-machine-2', '', 'too many modules'),
 (2, 'requester-chest', 'requests:wood=1;iron-plate=5', ''), (3, 'inserter', 'filter_mode:blacklist filters:iron-plate;stone', ''),
 (4, 'splitter', 'filter:stone output_priority:left', ''), (5, 'constant-combinator', 'signals:virtual:signal-A=7', ''), (6, 'pipe', '', 'direction'),
 (7, 'pipe', '', 'quality')) AS t(idx, name, settings, reject)""",
    "prompt_checks": """SELECT CAST(id AS INTEGER) AS id, CAST(conflicts AS VARCHAR) AS conflicts, CAST(lang AS VARCHAR) AS lang, CAST(turned AS VARCHAR) AS turned FROM (VALUES
 (0, '3 labs', 'en', 'Build 4 stone furnaces and 3 labs'), (1, '', 'en', 'A 13 by 18 block with 2 assembling machine 2 of level 2'), (2, '', 'en', '4 blue belts'),
 (3, '5 каменных печей', 'ru', 'Поставь 5 каменных печей'), (4, '1 lamp going north', 'en', '10 inserters and 1 lamp going East, then south'),
 (5, '', 'en', '90 degree turn, 160 MW, mk 2 machines')) AS t(id, conflicts, lang, turned)""",
    "answer_checks": """SELECT CAST(id AS INTEGER) AS id, CAST(chars AS INTEGER) AS chars, CAST(problem AS VARCHAR) AS problem FROM (VALUES
 (0, 62, ''), (1, 46, 'incomplete'), (2, 14, 'no blueprint'), (3, 17, 'no blueprint'), (4, 0, 'empty')) AS t(id, chars, problem)""",
    "scored_cases": """SELECT CAST(id AS VARCHAR) AS id, CAST(complete AS BOOLEAN) AS complete, CAST(valid AS BOOLEAN) AS valid, CAST(checks AS VARCHAR) AS checks, CAST(belt_tier_ok AS BOOLEAN) AS belt_tier_ok, CAST(contains_ok AS BOOLEAN) AS contains_ok, CAST(warnings_per_100 AS DOUBLE) AS warnings_per_100, CAST(issues AS INTEGER) AS issues FROM (VALUES
 ('a1', true, true, 'lab:11:false:true beacon:3:true:true recipe:x:1:false:true', true, true, 12.5, 2), ('a2', false, false, '', NULL, false, NULL, 0),
 ('b1', true, false, 'lab:4:true:true', true, true, 25.0, 2), ('b2', false, true, 'lab:1:true:true', NULL, NULL, 0.0, 0)) AS t(id, complete, valid, checks, belt_tier_ok, contains_ok, warnings_per_100, issues)""",
    "evaluation_summary": """SELECT CAST(block AS VARCHAR) AS block, CAST(n AS BIGINT) AS n, CAST(complete AS DOUBLE) AS complete, CAST(exec_ok AS DOUBLE) AS exec_ok, CAST(valid AS DOUBLE) AS valid, CAST(valid_first_attempt AS DOUBLE) AS valid_first_attempt, CAST(count_exact AS DOUBLE) AS count_exact, CAST(count_within10 AS DOUBLE) AS count_within10, CAST(belt_tier_ok AS DOUBLE) AS belt_tier_ok, CAST(contains_ok AS DOUBLE) AS contains_ok, CAST(median_warnings_per_100 AS DOUBLE) AS median_warnings_per_100, CAST(median_reference_warnings_per_100 AS DOUBLE) AS median_reference_warnings_per_100, CAST(mean_gen_tokens AS DOUBLE) AS mean_gen_tokens, CAST(mean_attempts AS DOUBLE) AS mean_attempts, CAST(issue_totals AS VARCHAR) AS issue_totals FROM (VALUES
 ('A', 2, 0.5, 0.5, 0.5, 0.5, 0.333, 1.0, 1.0, 0.5, 12.5, NULL, 75.0, 1.5, 'belt_end:2'),
 ('B', 2, 0.5, 1.0, 0.5, 0.5, 1.0, 1.0, 1.0, 1.0, 12.5, 6.25, 45.0, 2.0, 'belt_end:1 collision:1'),
 ('all', 4, 0.5, 0.75, 0.5, 0.5, 0.6, 1.0, 1.0, 0.667, 12.5, 6.25, 60.0, 1.75, 'belt_end:3 collision:1')) AS t(block, n, complete, exec_ok, valid, valid_first_attempt, count_exact, count_within10, belt_tier_ok, contains_ok, median_warnings_per_100, median_reference_warnings_per_100, mean_gen_tokens, mean_attempts, issue_totals)""",
    "layout_drawings": """SELECT CAST(layout_id AS VARCHAR) AS layout_id, CAST(map AS VARCHAR) AS map FROM (VALUES
 ('gears', '>>>' || chr(10) || '.i.' || chr(10) || 'VVV' || chr(10) || 'VVV' || chr(10) || 'VVV' || chr(10) || '.i.' || chr(10) || '>>>'),
 ('side', '.v......' || chr(10) || '>>>.....' || chr(10) || '........' || chr(10) || '........' || chr(10) || '........' || chr(10) || '.....GGG' || chr(10) || '.....GGG' || chr(10) || '.....GGG')) AS t(layout_id, map)""",
    "generated_modules": """SELECT CAST(module AS VARCHAR) AS module, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(name AS VARCHAR) AS name, CAST(n AS BIGINT) AS n, CAST(first_x AS INTEGER) AS first_x, CAST(first_y AS INTEGER) AS first_y FROM (VALUES
 ('assembling', 14, 12, 'assembling-machine-2', 7, 7, 7), ('assembling', 14, 12, 'inserter', 14, 6, 8), ('assembling', 14, 12, 'long-handed-inserter', 7, 10, 7),
 ('assembling', 14, 12, 'transport-belt', 48, 5, 7), ('circuits', 7, 39, 'assembling-machine-2', 10, 7, 7), ('circuits', 7, 39, 'bulk-inserter', 8, 8, 10),
 ('circuits', 7, 39, 'inserter', 14, 6, 8), ('circuits', 7, 39, 'transport-belt', 78, 5, 7), ('labs', 33, 11, 'inserter', 20, 8, 8), ('labs', 33, 11, 'lab', 20, 5, 7),
 ('labs', 33, 11, 'transport-belt', 11, 21, 7), ('mining', 7, 28, 'electric-mining-drill', 16, 5, 7), ('mining', 7, 28, 'transport-belt', 28, 8, 7),
 ('smelting', 11, 24, 'inserter', 48, 6, 7), ('smelting', 11, 24, 'stone-furnace', 24, 7, 7), ('smelting', 11, 24, 'transport-belt', 72, 5, 7),
 ('steam', 15, 14, 'boiler', 4, 7, 9), ('steam', 15, 14, 'burner-inserter', 4, 6, 10), ('steam', 15, 14, 'offshore-pump', 1, 7, 7), ('steam', 15, 14, 'pipe', 4, 14, 10),
 ('steam', 15, 14, 'steam-engine', 8, 9, 9), ('steam', 15, 14, 'transport-belt', 12, 5, 9)) AS t(module, width, height, name, n, first_x, first_y)""",
    "runs_and_wires": """SELECT CAST(what AS VARCHAR) AS what, CAST(first AS BIGINT) AS first, CAST(step AS BIGINT) AS step, CAST("count" AS BIGINT) AS "count" FROM (VALUES
 ('run a', 0, 5, 3), ('run b', 1, 4, 3), ('run b', 2, 4, 3), ('wire', 0, 1, 1), ('wire', 1, 2, 1), ('wire', 2, 3, 1)) AS t(what, first, step, "count")""",
}
