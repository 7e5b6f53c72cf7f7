"""Schemas of the document tables."""

SPAN = "doc_id long, page int, block int, line int, span int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, ox double, oy double, flags int"
LINE = "doc_id long, pos long, text string, baseline double, left_x double, right_x double, size double, bold boolean"
EVENT = "doc_id long, page int, ev int, top double, left double, markup string, text string, digest string, layout struct<baseline:double,left:double,right:double,size:double,bold:boolean>"
CHAPTER = "doc_id long, chapter_index long, title string, html string, source_location string"
WARNING = "doc_id long, code string, message string, severity string, location string"
ITEM = "pkg string, item_id string, path string, media_type string, properties array<string>, fallback string"
REFERENCE = "pkg string, item_id string, target string, kind string, remote boolean"
NAVIGATION = "pkg string, ord long, href string, base_url string"
PATCH = "doc_id long, seq long, original string, replacement string, reason string, confidence double"
STATE = "job string, source_hash string, batch_pages int, total_pages long, minimum_confidence double, max_corrections int, status string, completed_through_page long"
