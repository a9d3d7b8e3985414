"""The registered queries' results in DuckDB SQL, written independently of the DataFrame operators: no value is theirs."""

from __future__ import annotations

from docflow.plans.inputs import BLOCK, BOX, DEADLINE, FAILED_PAGE, FILLS, GROUND, KEPT, LABELS, LINES_SQL, PAGE, PAGES, PICTURE_BOX, REGISTERED, duck

#: Fixed values of the data format and of line breaks.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HYPHEN = r"[-\x{ad}\x{2010}\x{2011}\x{2043}]"
SENTENCE_END = r"[.!?。！？…”\x22]"
CJK = r"[\x{4e00}-\x{9fff}]"
SENSITIVE = r"^(?:#|- |\* |> |\||<table|</table|\$\$|[0-9]+\.|(?:Figure|Fig\.|Table)" + WS + r"*[0-9]+)"
TAG = r"(?:<\|ref\|>)?([a-zA-Z_]+)(?:<\|/ref\|>)?(?:<\|det\|>)?(\[\[([0-9]+(?:,[\t-\r ]*[0-9]+){3})\]\])(?:<\|/det\|>)?"
DIAGNOSIS = {"image": "red", "table": "blue", "chart": "orange", "title": "blue", "sub_title": "purple", "text": "green"}
OVERLAY = {"text": "green", "table": "blue", "formula": "red", "figure": "purple", "image": "purple", "chart": "purple"}
PROMPTS = {"table": ("Table Recognition:", 4096), "formula": ("Formula Recognition:", 256)}
TEXT_PROMPT = ("Text Recognition:", 1024)
FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SELECTIONS = ("1, 3-5, 10", "", "  ", "a, 2, 1-2-3, -5", "5-3", "0, 1", "99", "2,2, 2-3", "1 - 4", "7-100", "１")
HTML_TABLE = '<TABLE class="x"><tr><td>a</td></tr></table> and <table>\n<tr></tr></Table>'
BREAK = "chr(10) || chr(10) || '\\newpage' || chr(10) || chr(10)"
NL2 = "chr(10) || chr(10)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+\z', '')"


def unhyphened(x: str) -> str:
    return rf"regexp_replace({rstrip(x)}, '{HYPHEN}+\z', '')"


def joint(p: str, c: str, keeps: str) -> str:
    return rf"""CASE WHEN regexp_matches({p}, '\A{HYPHEN}') THEN 'H' WHEN {keeps} AND regexp_matches({c}, '\A\p{{Ll}}') THEN 'E'
                     WHEN regexp_matches({p}, '\A{CJK}') AND regexp_matches({c}, '\A{CJK}') THEN 'J' END"""


def classified(source: str, keys: str) -> str:
    """CTEs up to k: keys, i, line, s, kind."""
    return rf"""
        l AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM ({source})),
        t AS (SELECT *, {strip("line")} AS s FROM l),
        f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS inside FROM t),
        k AS (SELECT *, CASE WHEN starts_with(s, '```') THEN 'F' WHEN inside = 1 THEN 'C' WHEN s = '' THEN 'B' WHEN regexp_matches(s, '{SENSITIVE}') THEN 'S' ELSE 'T' END AS kind FROM f)"""


def reflowed(source: str, keys: str) -> str:
    """CTEs up to flowed: keys, text."""
    p = "lag(s) OVER w"
    ends = rf"NOT regexp_matches(right({p}, 1), '\A{SENTENCE_END}')"
    return rf"""{classified(source, keys)},
        h AS (SELECT *, CASE WHEN kind = 'T' AND lag(kind) OVER w = 'T' THEN {joint(f"right({p}, 1)", "s[1]", ends)} END AS how FROM k WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
        n AS (SELECT *, lead(how) OVER (PARTITION BY {keys} ORDER BY i) AS nxt, sum(CASE WHEN how IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS grp FROM h),
        g AS (SELECT {keys}, grp, string_agg(CASE WHEN how = 'E' THEN ' ' ELSE '' END || CASE WHEN nxt = 'H' THEN {unhyphened("CASE WHEN how IS NULL THEN line ELSE s END")} WHEN how IS NULL THEN line ELSE s END, '' ORDER BY i) AS seg FROM n GROUP BY {keys}, grp),
        flowed AS (SELECT {keys}, string_agg(seg, chr(10) ORDER BY grp) AS text FROM g GROUP BY {keys})"""


def stitched(source: str) -> str:
    """CTEs up to stitched: doc_id, text; source is the name of a table of doc_id, page_idx, text."""
    p = "lag(s) OVER w"
    keeps = rf"(regexp_matches(right({p}, 1), '\A\p{{L}}') OR right({p}, 1) = ',')"
    return rf"""
        pg AS (SELECT *, {strip("text")} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) = 1 AS first FROM {source}),
        full_pg AS (SELECT *, lag(s) OVER w IS NULL AS alone, {joint(f"right({p}, 1)", "s[1]", keeps)} AS how FROM pg WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx)),
        seg_pg AS (SELECT *, lead(how) OVER (PARTITION BY doc_id ORDER BY page_idx) AS nxt,
                          CASE WHEN alone AND first THEN text WHEN alone THEN s WHEN how IS NULL THEN {NL2} || text WHEN how = 'E' THEN ' ' || s ELSE s END AS seg FROM full_pg),
        stitched AS (SELECT doc_id, string_agg(CASE WHEN nxt = 'H' THEN {unhyphened("seg")} ELSE seg END, '' ORDER BY page_idx) AS text FROM seg_pg GROUP BY doc_id
                     UNION ALL SELECT doc_id, '' FROM pg GROUP BY doc_id HAVING max(s) = '')"""


def cuts(source: str, passes: int = 16) -> str:
    """CTEs up to ranked: boxes with block_idx; one set of window passes for each depth."""
    out = f"""
        b AS (SELECT * FROM ({source})),
        s0 AS (SELECT doc_id, page_idx, det_idx, x1, y1, x2, y2, '' AS path, det_idx AS ord,
                      CASE WHEN max(CASE WHEN lower(label) = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx) = 1 THEN 'Y' ELSE 'X' END AS dir FROM b)"""
    node = "PARTITION BY doc_id, page_idx, path"
    for k in range(passes):
        out += f""",
        a{k} AS (SELECT *, row_number() OVER w AS rn, count(*) OVER ({node}) AS cnt,
                        CASE WHEN dir = 'X' THEN lead(x1) OVER w - x2 ELSE lead(y1) OVER w - y2 END AS gap
                 FROM s{k} WINDOW w AS ({node} ORDER BY CASE WHEN dir = 'X' THEN x1 ELSE y1 END, ord)),
        m{k} AS (SELECT *, max(gap) OVER ({node}) AS mg FROM a{k}),
        c{k} AS (SELECT *, min(CASE WHEN gap = mg THEN rn END) OVER ({node}) AS cut,
                        CASE WHEN dir = 'T' OR cnt <= 1 THEN 'done' WHEN mg > 10 THEN 'split' WHEN dir = 'X' THEN 'turn' ELSE 'end' END AS act FROM m{k}),
        s{k + 1} AS (SELECT doc_id, page_idx, det_idx, x1, y1, x2, y2,
                            path || CASE WHEN act = 'split' THEN CASE WHEN rn <= cut THEN '0' ELSE '1' END ELSE '' END AS path,
                            CASE act WHEN 'done' THEN ord WHEN 'end' THEN row_number() OVER ({node} ORDER BY y1, x1, rn) ELSE rn END AS ord,
                            CASE act WHEN 'split' THEN CASE WHEN dir = 'X' THEN 'Y' ELSE 'X' END WHEN 'turn' THEN 'Y' ELSE 'T' END AS dir FROM c{k})"""
    return out + f""",
        ranked AS (SELECT b.*, CAST(row_number() OVER (PARTITION BY b.doc_id, b.page_idx ORDER BY s.path, s.ord) - 1 AS INTEGER) AS block_idx
                   FROM b JOIN s{passes} s USING (doc_id, page_idx, det_idx))"""


def headless(source: str) -> str:
    return f"""(SELECT * FROM (SELECT *, max(CASE WHEN lower(label) = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx) AS tab FROM {source})
                WHERE lower(label) <> 'footer' AND (lower(label) <> 'header' OR tab = 1))"""


def tagged(source: str, table: bool = True, formula: bool = False) -> str:
    return f"""(SELECT *, CASE WHEN lower(label) IN ('figure', 'image', 'chart') THEN 'fig' WHEN {table} AND lower(label) = 'table' THEN 'table' WHEN {formula} AND lower(label) = 'formula' THEN 'formula' END AS tag FROM {source})"""


WIDTH = """CASE WHEN tag IN ('fig', 'table') THEN CASE WHEN (x2 - x1) / page_w >= 0.65 THEN '{width=100%}' WHEN (x2 - x1) / page_w >= 0.35 THEN '{width=70%}' ELSE '{width=45%}' END
                WHEN tag IS NOT NULL THEN '' END"""


def chosen(column: str, names: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {default} END"


_KEPT = duck(KEPT)
def crops_sql(kept: str) -> str:
    """CTEs up to met: crops of boxes, and the neighbours that their padding meets."""
    return f"""
        p AS (SELECT *, greatest(6, CAST(floor((x2 - x1) * CAST(0.02 AS DOUBLE)) AS INTEGER)) AS dx, greatest(6, CAST(floor((y2 - y1) * CAST(0.03 AS DOUBLE)) AS INTEGER)) AS dy FROM ({kept})),
        crop AS (SELECT *, greatest(0, x1 - dx) AS px1, greatest(0, y1 - dy) AS py1, least(page_w, x2 + dx) AS px2, least(page_h, y2 + dy) AS py2 FROM p),
        met AS (SELECT t.*, o.det_idx AS o_idx, (o.x2 - o.x1) * (o.y2 - o.y1) AS o_area, greatest(t.px1, o.x1) - t.px1 AS lx1, greatest(t.py1, o.y1) - t.py1 AS ly1,
                       least(t.px2, o.x2) - t.px1 AS lx2, least(t.py2, o.y2) - t.py1 AS ly2
                FROM crop t JOIN ({kept}) o ON t.doc_id = o.doc_id AND t.page_idx = o.page_idx AND t.det_idx <> o.det_idx
                     AND o.x1 < t.px2 AND o.x2 > t.px1 AND o.y1 < t.py2 AND o.y2 > t.py1)"""


CORE_MASKS = """SELECT doc_id, page_idx, det_idx, o_idx, greatest(lx1, x1 - px1) AS x1, greatest(ly1, y1 - py1) AS y1, least(lx2, x2 - px1) AS x2, least(ly2, y2 - py1) AS y2
        FROM met WHERE o_area < (x2 - x1) * (y2 - y1) * 0.5 AND least(lx2, x2 - px1) > greatest(lx1, x1 - px1) AND least(ly2, y2 - py1) > greatest(ly1, y1 - py1)"""
RING_MASKS = """SELECT * FROM (
        SELECT doc_id, page_idx, det_idx, o_idx, 'left' AS side, lx1 AS x1, ly1 AS y1, least(lx2, m.x1 - px1) AS x2, ly2 AS y2 FROM met m
        UNION ALL SELECT doc_id, page_idx, det_idx, o_idx, 'right', greatest(lx1, m.x2 - px1), ly1, lx2, ly2 FROM met m
        UNION ALL SELECT doc_id, page_idx, det_idx, o_idx, 'top', lx1, ly1, lx2, least(ly2, m.y1 - py1) FROM met m
        UNION ALL SELECT doc_id, page_idx, det_idx, o_idx, 'bottom', lx1, greatest(ly1, m.y2 - py1), lx2, ly2 FROM met m) WHERE x2 > x1 AND y2 > y1"""
_BOXES = duck(PICTURE_BOX)
#: White pixels of crops: both corners of a mask are white; edges of all masks cut a crop into cells that are wholly covered or not.
WHITE = f"""{crops_sql(_BOXES)},
        r AS (SELECT m.doc_id, m.page_idx, m.det_idx, m.x1, m.y1, least(m.x2 + 1, c.px2 - c.px1) AS x2, least(m.y2 + 1, c.py2 - c.py1) AS y2
              FROM (SELECT doc_id, page_idx, det_idx, x1, y1, x2, y2 FROM ({CORE_MASKS}) UNION ALL SELECT doc_id, page_idx, det_idx, x1, y1, x2, y2 FROM ({RING_MASKS})) m JOIN crop c USING (doc_id, page_idx, det_idx)),
        xs AS (SELECT doc_id, page_idx, det_idx, x, lead(x) OVER (PARTITION BY doc_id, page_idx, det_idx ORDER BY x) AS nx FROM (SELECT DISTINCT doc_id, page_idx, det_idx, unnest([x1, x2]) AS x FROM r)),
        ys AS (SELECT doc_id, page_idx, det_idx, y, lead(y) OVER (PARTITION BY doc_id, page_idx, det_idx ORDER BY y) AS ny FROM (SELECT DISTINCT doc_id, page_idx, det_idx, unnest([y1, y2]) AS y FROM r)),
        cell AS (SELECT DISTINCT r.doc_id, r.page_idx, r.det_idx, x, nx, y, ny FROM r JOIN xs USING (doc_id, page_idx, det_idx) JOIN ys USING (doc_id, page_idx, det_idx) WHERE x >= r.x1 AND nx <= r.x2 AND y >= r.y1 AND ny <= r.y2),
        white AS (SELECT doc_id, page_idx, det_idx, CAST(sum((nx - x) * (ny - y)) AS INTEGER) AS n FROM cell GROUP BY ALL)"""

TAGS = rf"""
        raw AS (SELECT item_id, text, page_w, page_h, unnest(regexp_extract_all(text, '{TAG}', 1)) AS name, unnest(regexp_extract_all(text, '{TAG}', 3)) AS numbers,
                       unnest(range(len(regexp_extract_all(text, '{TAG}', 1)))) AS pos FROM ({duck(GROUND)})),
        nums AS (SELECT *, lower(name) AS tag, list_transform(regexp_extract_all(numbers, '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS c FROM raw),
        tg AS (SELECT item_id, CAST(pos AS INTEGER) AS pos, tag,
                      CASE WHEN contains(tag, 'caption') OR contains(tag, 'footnote') THEN NULL WHEN contains(tag, 'image') THEN 'image' WHEN contains(tag, 'table') THEN 'table' WHEN contains(tag, 'chart') THEN 'chart' END AS class,
                      greatest(0, CAST(trunc(c[1] / 1000.0 * page_w) AS INTEGER)) AS x1, greatest(0, CAST(trunc(c[2] / 1000.0 * page_h) AS INTEGER)) AS y1,
                      least(page_w, CAST(trunc(c[3] / 1000.0 * page_w) AS INTEGER)) AS x2, least(page_h, CAST(trunc(c[4] / 1000.0 * page_h) AS INTEGER)) AS y2 FROM nums)"""


def cleaned(x: str) -> str:
    for m in ("<|ref|>", "<|/ref|>", "<|det|>", "<|/det|>"):
        x = f"replace({x}, '{m}', '')"
    return rf"regexp_replace(regexp_replace({x}, '[a-zA-Z_]+\[\[.*?\]\]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


ASSEMBLY = f"""
        blk AS (SELECT * FROM ({duck(BLOCK)})), reg AS (SELECT * FROM ({duck(REGISTERED)})), fil AS (SELECT * FROM ({duck(FILLS)})),
        acc AS (SELECT f.doc_id, f.page_idx, f.block_idx, arg_min(f.content, f.seq) AS content, min(f.seq) AS seq
                FROM fil f JOIN blk b USING (doc_id, page_idx, block_idx) JOIN reg r USING (doc_id, page_idx) WHERE b.kind = 'ocr' AND f.seq > r.seq GROUP BY ALL),
        rdy AS (SELECT r.doc_id, r.page_idx, CASE WHEN count(b.block_idx) = count(a.block_idx) THEN greatest(max(r.seq), coalesce(max(a.seq), max(r.seq))) END AS ready_seq
                FROM reg r LEFT JOIN (SELECT * FROM blk WHERE kind = 'ocr') b USING (doc_id, page_idx) LEFT JOIN acc a USING (doc_id, page_idx, block_idx) GROUP BY ALL),
        flush AS (SELECT * FROM (SELECT *, max(ready_seq) OVER w AS flush_seq, count(*) OVER w = count(ready_seq) OVER w AND count(*) OVER w = page_idx + 1 AS ok
                                 FROM rdy WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx)) WHERE ok)"""


def styled(label: str, text: str) -> str:
    return f"""CASE {label} WHEN 'doc_title' THEN '# ' || {text} WHEN 'paragraph_title' THEN '## ' || {text} WHEN 'abstract' THEN '> **Abstract** — ' || {text}
                    WHEN 'algorithm' THEN '```' || chr(10) || {text} || chr(10) || '```' WHEN 'figure_title' THEN '*' || {text} || '*' ELSE {text} END"""


# contents are one line here, so reflowing them changes nothing
PAGE_MD = f"""{ASSEMBLY},
        md AS (SELECT b.doc_id, b.page_idx, b.block_idx, CASE WHEN b.kind = 'image' THEN '![' || label || '](' || image_path || ')' || width_str
                      WHEN a.content IS NOT NULL THEN {styled("label", "replace(a.content, '```', '')")} END AS md FROM blk b LEFT JOIN acc a USING (doc_id, page_idx, block_idx)),
        page_md AS (SELECT f.doc_id, f.page_idx, coalesce(string_agg({NL2} || md || {NL2}, {NL2} ORDER BY block_idx), '') AS markdown FROM flush f LEFT JOIN md USING (doc_id, page_idx) GROUP BY ALL)"""

MIDDLE = f"""{cuts(_KEPT)},
        tb AS (SELECT * FROM {tagged(headless("ranked"), formula=True)}),
        nb AS (SELECT *, CASE WHEN tag IS NOT NULL THEN 'images/p' || page_idx || '_' || tag || '_' || row_number() OVER (PARTITION BY doc_id, page_idx, tag ORDER BY block_idx) || '.png' END AS image_path FROM tb)"""


def selection() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SELECTIONS))
    whole, ends = r"\A[0-9]{1,9}\z", r"\A([0-9]{1,9})[\t-\r ]*-[\t-\r ]*([0-9]{1,9})\z"
    return rf"""
        WITH sel AS (SELECT * FROM (VALUES {rows}) v(sel_id, sel)),
        part AS (SELECT sel_id, {strip("unnest(string_split(sel, ','))")} AS part FROM sel),
        num AS (SELECT sel_id, CAST(part AS INTEGER) AS p FROM part WHERE regexp_matches(part, '{whole}')
                UNION SELECT sel_id, unnest(range(CAST(regexp_extract(part, '{ends}', 1) AS INTEGER), CAST(regexp_extract(part, '{ends}', 2) AS INTEGER) + 1)) FROM part WHERE regexp_matches(part, '{ends}')),
        chosen AS (SELECT sel_id, CASE WHEN {strip("sel")} <> '' THEN coalesce((SELECT list(DISTINCT p - 1 ORDER BY p - 1) FROM num WHERE num.sel_id = sel.sel_id AND p >= 1), []) END AS selected FROM sel),
        pg AS (SELECT page_id, page_id % 13 AS total, selected FROM pages JOIN chosen ON page_id % {len(SELECTIONS)} = sel_id)
        SELECT page_id, array_to_string(selected, ',') AS selected,
               array_to_string(CASE WHEN selected IS NULL OR len(list_filter(selected, lambda p: p < total)) = 0 THEN range(total) ELSE list_filter(selected, lambda p: p < total) END, ',') AS pages FROM pg"""


#: Pages in order, with failure texts for what is missing at the deadline, if the log goes on beyond it.
DEADLINES = f"""WITH reg AS (SELECT *, seq + {DEADLINE} AS due, {FAILED_PAGE} AS failed FROM ({duck(REGISTERED)})), fil AS (SELECT * FROM ({duck(FILLS)})),
        last AS (SELECT max(seq) AS now FROM (SELECT seq FROM reg UNION ALL SELECT seq FROM fil)),
        blk AS (SELECT b.doc_id, b.page_idx, b.block_idx, r.seq, r.due FROM ({duck(BLOCK)}) b JOIN reg r USING (doc_id, page_idx) WHERE b.kind = 'ocr' AND NOT r.failed),
        got AS (SELECT b.doc_id, b.page_idx, b.block_idx, arg_min(f.content, f.seq) AS content, min(f.seq) AS seq FROM blk b JOIN fil f USING (doc_id, page_idx, block_idx) WHERE f.seq > b.seq AND f.seq <= b.due GROUP BY ALL),
        told AS (SELECT b.doc_id, b.page_idx, b.block_idx, CASE WHEN g.seq IS NOT NULL THEN replace(g.content, '```', '') WHEN b.due < now THEN '[OCR识别失败: no answer in time]' END AS content,
                        CASE WHEN g.seq IS NOT NULL THEN g.seq WHEN b.due < now THEN b.due END AS seq FROM blk b CROSS JOIN last LEFT JOIN got g USING (doc_id, page_idx, block_idx)),
        page AS (SELECT r.doc_id, r.page_idx, CASE WHEN failed THEN r.seq WHEN count(t.block_idx) = count(t.seq) THEN greatest(r.seq, coalesce(max(t.seq), r.seq)) END AS ready,
                        CASE WHEN failed THEN '[Layout分析异常: no picture]' ELSE coalesce(string_agg(t.content, '|' ORDER BY t.block_idx), '') END AS contents
                 FROM reg r LEFT JOIN told t USING (doc_id, page_idx) GROUP BY r.doc_id, r.page_idx, r.seq, failed),
        run AS (SELECT *, max(ready) OVER w AS flush_seq, count(*) OVER w = count(ready) OVER w AND count(*) OVER w = page_idx + 1 AS ok FROM page WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx))
        SELECT doc_id, page_idx, flush_seq, contents FROM run WHERE ok"""

REQUESTS = f"""SELECT doc_id, page_idx, det_idx, label, (page_idx + det_idx) % 5 AS f, {chosen("lower(label)", {k: p for k, (p, _) in PROMPTS.items()}, f"'{TEXT_PROMPT[0]}'")} AS prompt FROM ({_KEPT})"""

ORACLE_SQL = {
    "text_fullwidth": f"SELECT doc_id, translate(text, '{FULL}', '{HALF}') AS text FROM ({LINES_SQL})",
    "line_classify": f"WITH {classified(LINES_SQL, 'doc_id')} SELECT doc_id, kind, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM k GROUP BY ALL",
    "reflow_documents": f"WITH {reflowed(LINES_SQL, 'doc_id')} SELECT doc_id, text FROM flowed",
    "stitch_conversations": f"WITH src AS ({duck(PAGE)}), {stitched('src')} SELECT doc_id, text FROM stitched",
    "merge_paginated": f"SELECT doc_id, string_agg({strip('text')}, {BREAK} ORDER BY page_idx) AS text FROM ({duck(PAGE)}) GROUP BY doc_id",
    "merge_stream": f"WITH {reflowed(duck(PAGE), 'doc_id, page_idx')}, {stitched('flowed')} SELECT doc_id, text FROM stitched",
    "box_filter_score": f"SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY det_idx) - 1 AS INTEGER) AS det_idx, score, x1, y1, x2, y2 FROM ({_KEPT})",
    "box_label_lookup": f"SELECT CASE WHEN label_id % 5 = 0 THEN 'Label_' || label_id ELSE label END AS label, count(*) AS n, CAST(sum(x1) AS BIGINT) AS sum_x1 FROM ({_KEPT}) GROUP BY ALL",
    "header_footer_filter": f"SELECT doc_id, page_idx, det_idx, label FROM {headless(f'({_KEPT})')}",
    "reading_order": f"WITH {cuts(_KEPT)} SELECT doc_id, page_idx, det_idx, block_idx FROM ranked",
    "route_blocks": f"SELECT doc_id, page_idx, det_idx, CASE WHEN tag IS NULL THEN 'ocr' ELSE 'image' END AS kind, tag FROM {tagged(headless(f'({_KEPT})'))}",
    "crop_names": f"""WITH {cuts(_KEPT)} SELECT doc_id, page_idx, block_idx,
        'images/page_' || lpad(CAST(page_idx AS VARCHAR), 7, '0') || '_' || tag || '_' || row_number() OVER (PARTITION BY doc_id, page_idx, tag ORDER BY block_idx) || '.png' AS image_path
        FROM {tagged(headless("ranked"), formula=True)} WHERE tag IS NOT NULL""",
    "width_bucket": f"SELECT tag, {WIDTH} AS width_str, count(*) AS n FROM {tagged(f'({_KEPT})', formula=True)} GROUP BY ALL",
    "prompt_policy": f"""SELECT label, {chosen("lower(label)", {k: p for k, (p, _) in PROMPTS.items()}, f"'{TEXT_PROMPT[0]}'")} AS prompt,
        CAST({chosen("lower(label)", {k: str(n) for k, (_, n) in PROMPTS.items()}, f"'{TEXT_PROMPT[1]}'")} AS INTEGER) AS max_tokens, count(*) AS n
        FROM {tagged(f"({_KEPT})", table=False)} WHERE tag IS NULL GROUP BY ALL""",
    "overlay_colors": f"SELECT label, {chosen('lower(label)', OVERLAY, chr(39) + 'yellow' + chr(39))} AS color, count(*) AS n, CAST(sum(x1) AS BIGINT) AS sum_x, CAST(sum(greatest(0, y1 - 12)) AS BIGINT) AS sum_y FROM ({_KEPT}) GROUP BY ALL",
    "crop_geometry": f"""WITH {crops_sql(_KEPT)} SELECT doc_id, page_idx, det_idx, px1, py1, px2, py2,
        CASE WHEN py2 - py1 < 64 THEN CAST(trunc((px2 - px1) * (CAST(128 AS DOUBLE) / (py2 - py1))) AS INTEGER) ELSE px2 - px1 END AS out_w,
        CASE WHEN py2 - py1 < 64 THEN 128 ELSE py2 - py1 END AS out_h FROM crop""",
    "mask_rects_core": f"WITH {crops_sql(_KEPT)} {CORE_MASKS}",
    "mask_rects_ring": f"WITH {crops_sql(_KEPT)} {RING_MASKS}",
    "image_scan": f"""SELECT 'p' || page_idx || '.png' AS file_name, 240 AS width, 200 AS height, 3 AS channels, md5(list_aggregate(list_transform(range(80), lambda x: repeat(printf('%02X', (x * 3 + page_idx) % 250), 3)), 'string_agg', '')) AS begins
        FROM (SELECT DISTINCT page_idx FROM ({_BOXES}))""",
    "mask_pixels": f"""WITH {WHITE}, t AS (SELECT *, tag IS NOT NULL AS plain FROM {tagged("crop")})
        SELECT doc_id, page_idx, det_idx, CASE WHEN plain THEN 'image' ELSE 'ocr' END AS kind, CASE WHEN plain THEN 0 ELSE coalesce(n, 0) END AS n_white,
               CASE WHEN plain THEN x2 - x1 WHEN py2 - py1 < 64 THEN CAST(trunc((px2 - px1) * (CAST(128 AS DOUBLE) / (py2 - py1))) AS INTEGER) ELSE px2 - px1 END AS width,
               CASE WHEN plain THEN y2 - y1 WHEN py2 - py1 < 64 THEN 128 ELSE py2 - py1 END AS height
        FROM t LEFT JOIN white USING (doc_id, page_idx, det_idx)""",
    "crop_files": f"""WITH {cuts(_BOXES)} SELECT doc_id || '/images/page_' || lpad(CAST(page_idx AS VARCHAR), 7, '0') || '_' || tag || '_' || row_number() OVER (PARTITION BY doc_id, page_idx, tag ORDER BY block_idx) || '.png' AS path,
        x2 - x1 AS width, y2 - y1 AS height FROM {tagged(headless("ranked"), formula=True)} WHERE tag IS NOT NULL""",
    "document_files": f"""WITH {PAGE_MD}, f AS (SELECT doc_id || '/final_output.md' AS path, string_agg(CASE WHEN page_idx > 0 THEN {BREAK} || markdown ELSE markdown END, '' ORDER BY page_idx) AS text FROM page_md GROUP BY doc_id
            UNION ALL SELECT doc_id || '/pages/page_' || lpad(CAST(page_idx + 1 AS VARCHAR), 5, '0') || '.md', markdown FROM page_md)
        SELECT path, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha FROM f""",
    "skew_median": f"""WITH a AS (SELECT doc_id, page_idx, degrees(atan2(CAST(y1 + y2 % 90 - 40 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) AS d FROM ({_KEPT}))
        SELECT doc_id, page_idx, round(coalesce(median(CASE WHEN d > -15 AND d < 15 THEN d END), 0), 6) AS skew FROM a GROUP BY ALL""",
    "ground_extract": f"WITH {TAGS} SELECT * FROM tg",
    "ground_rewrite": rf"""WITH {TAGS},
        ok AS (SELECT *, CASE WHEN class IS NOT NULL AND x2 > x1 AND y2 > y1 THEN sum(CASE WHEN x2 > x1 AND y2 > y1 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, class ORDER BY pos) END AS n FROM tg),
        piece AS (SELECT item_id, CAST(unnest(range(len(string_split_regex(text, '{TAG}')))) AS INTEGER) AS pos, unnest(string_split_regex(text, '{TAG}')) AS piece FROM ({duck(GROUND)})),
        whole AS (SELECT p.item_id, string_agg(piece || CASE WHEN n IS NOT NULL THEN {NL2} || '![' || class || '](images/page_' || p.item_id || '_' || class || '_' || CAST(n AS BIGINT) || '.png)' || {NL2} ELSE '' END, '' ORDER BY p.pos) AS text
                  FROM piece p LEFT JOIN ok USING (item_id, pos) GROUP BY p.item_id)
        SELECT item_id, {cleaned("text")} AS text FROM whole""",
    "ground_cleanup": f"SELECT item_id, {cleaned('text || chr(10) || chr(10) || chr(10) || chr(10) || ' + chr(39) + 'x' + chr(39))} AS text FROM ({duck(GROUND)})",
    "ground_diagnosis": f"WITH {TAGS} SELECT item_id, pos, tag, {chosen('coalesce(class, tag)', DIAGNOSIS, chr(39) + 'yellow' + chr(39))} AS color FROM tg",
    "page_selection": selection(),
    "fill_first_wins": f"WITH {ASSEMBLY} SELECT doc_id, page_idx, block_idx, content, seq FROM acc",
    "ordered_flush": f"WITH {ASSEMBLY} SELECT doc_id, page_idx, ready_seq, flush_seq FROM flush",
    "assemble_pages": f"WITH {PAGE_MD} SELECT doc_id, page_idx, markdown FROM page_md",
    "assemble_document": f"WITH {PAGE_MD} SELECT doc_id, string_agg(CASE WHEN page_idx > 0 THEN {BREAK} || markdown ELSE markdown END, '' ORDER BY page_idx) AS text FROM page_md GROUP BY doc_id",
    "stream_assemble": f"""WITH {ASSEMBLY} SELECT f.doc_id, f.page_idx, f.flush_seq, string_agg(replace(a.content, '```', ''), '|' ORDER BY a.block_idx) AS contents
        FROM flush f JOIN acc a USING (doc_id, page_idx) GROUP BY ALL""",
    "middle_json_roundtrip": f"""WITH {MIDDLE}, pg AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(page_h) AS BIGINT) AS sum_h FROM ({duck(PAGES)}) GROUP BY doc_id)
        SELECT doc_id, n_pages, sum_h, count(*) AS n_blocks, count(CASE WHEN tag IS NULL THEN 1 END) AS n_content, count(tag) AS n_images, CAST(sum(x1) AS BIGINT) AS sum_x1, count(DISTINCT lower(label)) AS n_labels
        FROM nb JOIN pg USING (doc_id) GROUP BY ALL""",
    "middle_files": f"""WITH {MIDDLE}, pg AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(page_h) AS BIGINT) AS sum_h FROM ({duck(PAGES)}) GROUP BY doc_id)
        SELECT doc_id || '_middle' AS doc_id, n_pages, sum_h, count(*) AS n_blocks, count(CASE WHEN tag IS NULL THEN 1 END) AS n_content, count(tag) AS n_images, CAST(sum(x1) AS BIGINT) AS sum_x1, count(DISTINCT lower(label)) AS n_labels
        FROM nb JOIN pg USING (doc_id) GROUP BY ALL""",
    "cached_render": f"""WITH {MIDDLE},
        md AS (SELECT doc_id, page_idx, block_idx, {NL2} || CASE WHEN tag IS NOT NULL THEN '![' || lower(label) || '](' || image_path || ')' ELSE {styled("lower(label)", "'Text ' || block_idx || 'end of block'")} END || {NL2} AS md FROM nb),
        pg AS (SELECT p.doc_id, p.page_idx, coalesce(string_agg(md, {NL2} ORDER BY block_idx), '') AS text FROM ({duck(PAGES)}) p LEFT JOIN md USING (doc_id, page_idx) GROUP BY ALL),
        doc AS (SELECT doc_id, string_agg(text, {BREAK} ORDER BY page_idx) AS text FROM pg GROUP BY doc_id)
        SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS sha FROM doc""",
    "cache_split": """SELECT lang, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS cached, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS sum_id FROM documents GROUP BY ALL""",
    "html_table_spans": rf"""WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html || '{HTML_TABLE}' ELSE html END AS html FROM pages)
        SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<table.*?>.*?</table>')) AS INTEGER) AS n, array_to_string(regexp_extract_all(html, '(?is)<table.*?>.*?</table>'), '|') AS tables FROM h""",
    "chat_payload": """SELECT doc_id, md5('{"model":"m","messages":[{"role":"user","content":[{"type":"image_url","image_url":{"url":"data:image/png;base64,' || base64(encode(text))
        || '"}},{"type":"text","text":"Text Recognition:"}]}],"temperature":0.0,"max_tokens":1024}') AS payload_md5, 'r' || doc_id AS reply FROM documents WHERE text IS NOT NULL""",
    "infer_stub": "SELECT 'd' AS doc_id, CAST(r_regionkey AS INTEGER) AS page_idx, 0 AS block_idx, 'Text Recognition: 1024 160x120' AS content, CAST(NULL AS VARCHAR) AS status, 1 AS attempts FROM region",
    "request_blocks": f"""SELECT doc_id, page_idx, det_idx AS block_idx, CASE WHEN f < 3 THEN prompt || ' ' || f || ':' || page_idx || ':' || det_idx ELSE {NL2} || '[OCR识别失败：此区域识别超时或服务端异常，标签为: ' || label || ']' || {NL2} END AS content,
        CASE WHEN f >= 3 THEN 'ConnectionError: failure 3' END AS status, CAST(least(f + 1, 3) AS INTEGER) AS attempts FROM ({REQUESTS})""",
    "request_inner": f"SELECT doc_id, page_idx, det_idx AS block_idx, prompt || ' ' || f || ':' || page_idx || ':' || det_idx AS content, CAST(f + 1 AS INTEGER) AS attempts FROM ({REQUESTS}) WHERE f < 2",
    "page_requests": f"""SELECT doc_id, page_idx, CASE page_idx % 4 WHEN 1 THEN 'Table' WHEN 2 THEN 'Formula' ELSE 'Text' END || ' Recognition: 1536 240x200' AS content, 1 AS attempts
        FROM (SELECT DISTINCT doc_id, page_idx FROM ({_BOXES}))""",
    "pdf_scan": """WITH p AS (SELECT s_suppkey AS s, unnest(range(s_suppkey % 40 + 1)) AS k FROM supplier)
        SELECT CAST(s AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS page_idx, 'page_' || lpad(CAST(k + 1 AS VARCHAR), 5, '0') AS stem, CAST(150 + 3 * ((s + k) % 3) AS INTEGER) AS width, CAST(200 + 6 * (k % 2) AS INTEGER) AS height,
               CAST(150 + 3 * ((s + k) % 3) AS INTEGER) AS drawn_w, CAST(200 + 6 * (k % 2) AS INTEGER) AS drawn_h, CAST(NULL AS VARCHAR) AS status FROM p WHERE k IN (0, 2, 3, 4, 29)""",
    "stream_deadline": DEADLINES,
    "batch_deadline": DEADLINES,
    "skew_pages": f"SELECT DISTINCT doc_id, page_idx, true AS found, true AS straight FROM ({_BOXES})",
    "table_markdown": rf"""WITH t AS (SELECT page_id, {NL2} || '| A' || page_id || ' | B\|' || page_id % 7 || ' |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '|  | ' || page_id % 7 || ' | d & e |' || chr(10)
            || '| ' || page_id || ' |  |  |' || {NL2} AS md FROM pages) SELECT page_id, 'before ' || md || ' between ' || md || ' after' AS text FROM t""",
    "overlay_pixels": f"""WITH b AS (SELECT *, CASE lower(label) WHEN 'text' THEN '008000' WHEN 'table' THEN 'FF0000' WHEN 'formula' THEN '0000FF' WHEN 'figure' THEN '800080' WHEN 'image' THEN '800080' WHEN 'chart' THEN '800080' ELSE '00FFFF' END AS bgr FROM ({_BOXES}))
        SELECT p.doc_id, p.page_idx, p.det_idx, arg_max(o.bgr, o.det_idx) AS bgr FROM b p JOIN b o ON p.page_idx = o.page_idx AND p.x1 BETWEEN o.x1 AND o.x2 AND p.y1 BETWEEN o.y1 AND o.y2
             AND (p.x1 < o.x1 + 3 OR p.x1 > o.x2 - 3 OR p.y1 < o.y1 + 3 OR p.y1 > o.y2 - 3) GROUP BY ALL""",
    "progress_counts": f"SELECT count(*) AS completed, count(CASE WHEN f < 3 THEN 1 END) AS succeeded, count(CASE WHEN f >= 3 THEN 1 END) AS failed FROM ({REQUESTS})",
}
