"""Names and fixed values of the engine: entities, statuses, the rule catalogue, categories."""

from __future__ import annotations

from dataclasses import dataclass

PASS, FAIL, WARNING, MANUAL, NOT_APPLICABLE, ERROR = "PASS", "FAIL", "WARNING", "MANUAL REVIEW", "NOT APPLICABLE", "ERROR"
CRITICAL, HIGH, MEDIUM, LOW, INFO = "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"
#: Statuses that count as problems.
PROBLEMS = (FAIL, WARNING, ERROR)

#: Entity tables and their columns, all keyed by doc_id.  Ordered lists carry an ordinal.
ENTITIES = {
    "documents": "doc_id long, filename string, pdf_version string, page_count int, title string, doc_info_title string, xmp_dc_title string, language string, is_tagged boolean, has_structure_tree boolean, is_encrypted boolean, allows_extraction boolean, display_doc_title boolean, has_suspects boolean, xmp_metadata_present boolean, pdfua_identifier_present boolean, pdfua_part int, has_parent_tree boolean, parent_tree_valid boolean, parent_tree_entries_count int, embedded_files_count int, bookmarks_count int, stream_text_strings int, filepath string, filesize long, author string, subject string, xmp_dc_description string, keywords string, creator string, producer string, creation_date string, modification_date string",
    "nodes": "doc_id long, node_id string, parent_id string, pos int, subtree_end int, depth int, tag string, standard_tag string, title string, alt_text string, actual_text string, lang string, page int, attr_o string, attr_type string, attr_placement string, attr_ref string, attr_dest string, bbox_state string, struct_bbox_valid boolean, has_area boolean, has_explicit_bbox boolean, placement string, obj_num int, has_pg_attr boolean, is_artifact boolean, text_content string, row_span int, col_span int",
    "node_mcids": "doc_id long, node_id string, ord int, mcid int, explicit_page int, is_entry boolean",
    "node_pages": "doc_id long, node_id string, page int",
    "pages": "doc_id long, page_number int, width double, height double, text string, links_count int, annotations_count int, has_structure boolean, tab_order_mode string, struct_parents_id int, unmarked int, tagged_ops int, artifact_ops int, tagged_in_artifact int",
    "page_mcids": "doc_id long, page_number int, ord int, mcid int, text string, x0 double, y0 double, x1 double, y1 double",
    "occurrences": "doc_id long, page_number int, ord int, mcid int, is_inside_tagged boolean, is_unmarked boolean",
    "artifacts": "doc_id long, page_number int, ord int, is_inside_tagged boolean, text_snippet string",
    "fonts": "doc_id long, ord int, name string, is_embedded boolean, has_tounicode boolean, has_standard_encoding boolean, encoding string, is_used boolean",
    "font_pages": "doc_id long, font_ord int, idx int, page int",
    "images": "doc_id long, ord int, image_id string, xref int, page int, is_artifact boolean, has_alt boolean, alt_text string, structure_element_id string",
    "links": "doc_id long, ord int, page int, text string, uri string",
    "form_fields": "doc_id long, ord int, name string, page int, tooltip string",
    "annotations": "doc_id long, ord int, annot_id string, subtype string, page int, is_tagged boolean",
    "form_xobjects": "doc_id long, ord int, is_valid boolean",
    "role_map": "doc_id long, custom_tag string, mapped_tag string",
    # What stands where on a page, from its upper left corner; boxes of the kind layout are in user space, from the lower left.
    "spans": "doc_id long, page_number int, ord int, block int, font string, size double, text string, x0 double, y0 double, x1 double, y1 double",
    "drawings": "doc_id long, page_number int, ord int, x0 double, y0 double, x1 double, y1 double",
    "boxes": "doc_id long, kind string, page_number int, ord int, node_id string, x0 double, y0 double, x1 double, y1 double",
    # Files of a scan that could not be read.
    "errors": "doc_id long, filename string, kind string, message string",
    "parent_tree": "doc_id long, sp_id int, is_array boolean, idx int, is_null boolean, target_obj int, target_tag string",
}

#: Standard structure types, exact names (fixed values of the PDF standard).
STANDARD_TYPES = (
    "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody "
    "Table TR TH TD Span Quote Note Reference BibEntry Code Link Annot Figure Formula Form Ruby RB RT RP Warichu WT WP"
).split()
INLINE_ROLES = "Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP".split()
ILLUSTRATION_ROLES = "Figure Formula Form".split()
CONTAINERS = "Sect Div Part Art".split()
BLOCK_PARENTS = "DOCUMENT PART ART SECT DIV".split()
HEADINGS = "H H1 H2 H3 H4 H5 H6".split()

#: Roles that must not stand directly inside a role (fixed values; they go beyond the standard's clause 14.8.4 in places).
INADMISSIBLE = {
    "P": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H1": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H2": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H3": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H4": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H5": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "H6": ["Document", "Part", "Art", "Sect", "Table", "L", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P"],
    "Span": ["Document", "Part", "Art", "Sect", "Div", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L", "TR", "TH", "TD", "LI"],
    "Quote": ["Document", "Part", "Art", "Sect", "Table", "L", "H1", "H2", "H3", "H4", "H5", "H6"],
    "Code": ["Document", "Part", "Art", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L"],
    "Link": ["Document", "Part", "Art", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L"],
    "Annot": ["Document", "Part", "Art", "Sect", "Div", "P", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L"],
    "Lbl": ["Document", "Part", "Art", "Sect", "Div", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L", "LI"],
    "LBody": ["Document", "Part", "Art", "Sect"],
    "L": ["Document", "Part", "Art", "Sect", "Div", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "Span", "Link", "Quote"],
    "LI": ["Document", "Part", "Art", "Sect", "Div", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L", "Span", "Link"],
    "Table": ["Document", "Part", "Art", "Sect", "Div", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Span", "Link", "TH", "TD"],
    "TR": ["Document", "Part", "Art", "Sect", "Div", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "Table", "L", "Span", "Link", "TR"],
    "TH": ["Document", "Part", "Art", "Sect"],
    "TD": ["Document", "Part", "Art", "Sect"],
    "Caption": ["Document", "Part", "Art", "Sect", "Table", "L"],
    "Note": ["Document", "Part", "Art", "Sect"],
}

#: Patterns and word lists (fixed values).
BCP47 = r"^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$"
FILE_NAME = r"(?i)^.*\.(png|jpe?g|gif|bmp|tiff|svg|webp|ico|pdf)$"
PLACEHOLDER = r"(?i)^(image|figure|photo|graphic|picture|placeholder|untitled|alt text)$"
PLACEHOLDER_QUALITY = r"(?i)^(image|figure|photo|graphic|picture|placeholder|untitled|alt\s*text|logo|icon|spacer|banner|drawing|diagram|clipart)$"
VAGUE_LINK = r"(?i)^(click\s+here|read\s+more|learn\s+more|more\s+info|more\s+details|link|here|more)(\.{0,3}|…)?$"
PAGINATION = r"(?i)^(page\s*\d+(\s+of\s+\d+)?|\d+(\s+of\s+\d+)?|chapter\s*\d+|section\s*\d+)$"
MATH_OR_CODE = r"[∈∉⊂⊆∪∩×÷√∫∑∏∂∇∆ΔθλωΩπ≤≥≠≈≡±∓∞→↔⇒⇔{}\[\]^_\\~|]"
REDUNDANT_ALT = r"(?i)^(image of|picture of|photo of|graphic of|screenshot of|diagram of)\s+"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}]"
TEXT_ROLES = "P SPAN H1 H2 H3 H4 H5 H6 LBODY TH TD QUOTE BIBENTRY".split()
TEXT_ROLES_WIDE = "P SPAN H1 H2 H3 H4 H5 H6 CAPTION QUOTE BLOCKQUOTE LBODY TH TD BIBENTRY CODE".split()
LIST_ITEM_DISALLOWED = "P SPAN H1 H2 H3 H4 H5 H6 TABLE DIV SECT FIGURE".split()
STANDARD_ENCODINGS = ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding")
GENERIC_TITLES = ("untitled", "microsoft word - document1", "document1", "default")


@dataclass(frozen=True)
class Rule:
    ord: int
    check_id: str
    name: str
    category: str
    standard: str
    severity: str
    machine_testable: bool = True


#: The rule catalogue in registry order (fixed values).
CATALOGUE = [
    Rule(1, "PDFUA-SYNTAX-001", "PDF Syntax (ISO 32000-1) Core", "PDF Syntax (ISO 32000-1)", "PDF/UA", "CRITICAL"),
    Rule(2, "PDFUA-FONT-001", "Fonts Embedded", "Fonts", "PDF/UA", "HIGH"),
    Rule(3, "PDFUA-FONT-002", "ToUnicode CMaps", "Fonts", "PDF/UA", "HIGH"),
    Rule(4, "PDFUA-UNICODE-001", "Unicode Private Use Area", "Natural language", "PDF/UA", "HIGH"),
    Rule(5, "PDFUA-UNICODE-002", "Replacement Characters", "Natural language", "PDF/UA", "HIGH"),
    Rule(6, "PDFUA-CONTENT-001", "Tagged PDF", "Content", "PDF/UA", "CRITICAL"),
    Rule(7, "PDFUA-CONTENT-002", "Real Content Tagged", "Content", "PDF/UA", "HIGH"),
    Rule(8, "PDFUA-CONTENT-004", "Tagged Content inside Artifact", "Content", "PDF/UA", "HIGH"),
    Rule(9, "PDFUA-CONTENT-005", "MCID Reference Integrity", "Content", "PDF/UA", "HIGH"),
    Rule(10, "PDFUA-CONTENT-006", "Structure Element MCID Existence", "Content", "PDF/UA", "HIGH"),
    Rule(11, "PDFUA-CONTENT-007", "Nested Marked Content", "Content", "PDF/UA", "HIGH"),
    Rule(12, "PDFUA-ARTIFACT-001", "Artifacts in Structure Tree", "Content", "PDF/UA", "HIGH"),
    Rule(13, "PDFUA-ART-003", "Artifacts inside tagged content", "Content", "PDF/UA", "HIGH"),
    Rule(14, "PDFUA-ANNOT-001", "Annotations Tagged", "Content", "PDF/UA", "HIGH"),
    Rule(15, "PDFUA-ANNOT-002", "Page Tab Order", "Annotations", "PDF/UA", "HIGH"),
    Rule(16, "PDFUA-FORM-001", "Form Field Tooltips & Names", "Forms", "PDF/UA", "HIGH"),
    Rule(17, "PDFUA-EMBEDDED-001", "Embedded Files", "Embedded Files", "PDF/UA", "MEDIUM"),
    Rule(18, "PDFUA-LANG-001", "Document Language", "Natural language", "PDF/UA", "HIGH"),
    Rule(19, "PDFUA-LANG-002", "Language Shifts", "Natural language", "PDF/UA", "MEDIUM"),
    Rule(20, "PDFUA-TREE-001", "Structure Tree Hierarchy & Containment", "Structure tree", "PDF/UA", "CRITICAL"),
    Rule(21, "PDFUA-TREE-002", "ParentTree Integrity", "Structure tree", "PDF/UA", "HIGH"),
    Rule(22, "PDFUA-STRUCT-001", "Structure Elements Validation & Nesting", "Structure elements", "PDF/UA", "HIGH"),
    Rule(23, "PDFUA-FIG-001", "Figure Bounding Box", "Structure elements", "PDF/UA", "HIGH"),
    Rule(24, "PDFUA-LIST-001", "List Structure Hierarchy", "Structure elements", "PDF/UA", "HIGH"),
    Rule(25, "PDFUA-TABLE-001", "Table Headers & Structure", "Tables", "PDF/UA", "HIGH"),
    Rule(26, "PDFUA-STRUCT-002", "Empty Structure Elements", "Structure elements", "PDF/UA", "HIGH"),
    Rule(27, "PDFUA-ROLE-001", "Role Mapping", "Role mapping", "PDF/UA", "HIGH"),
    Rule(28, "PDFUA-ALT-001", "Alternative Descriptions", "Alternative Descriptions", "PDF/UA", "HIGH"),
    Rule(29, "PDFUA-META-001", "XMP Metadata Stream", "Metadata", "PDF/UA", "HIGH"),
    Rule(30, "PDFUA-META-002", "XMP Document Title", "Metadata", "PDF/UA", "HIGH"),
    Rule(31, "PDFUA-META-003", "PDF/UA Identifier", "Metadata", "PDF/UA", "HIGH"),
    Rule(32, "PDFUA-SETTINGS-001", "DisplayDocTitle", "Document settings", "PDF/UA", "HIGH"),
    Rule(33, "PDFUA-SETTINGS-003", "Document Bookmarks", "Document settings", "PDF/UA", "MEDIUM"),
    Rule(34, "WCAG-1.1.1", "1.1 Text Alternatives", "1.1 Text Alternatives", "WCAG", "HIGH"),
    Rule(35, "WCAG-1.2", "1.2 Time-based Media", "1.2 Time-based Media", "WCAG", "MEDIUM"),
    Rule(36, "WCAG-1.3", "1.3 Adaptable", "1.3 Adaptable", "WCAG", "HIGH"),
    Rule(37, "WCAG-1.4", "1.4 Distinguishable", "1.4 Distinguishable", "WCAG", "MEDIUM", machine_testable=False),
    Rule(38, "WCAG-2.1", "2.1 Keyboard Accessible", "2.1 Keyboard Accessible", "WCAG", "HIGH"),
    Rule(39, "WCAG-2.2", "2.2 Enough Time", "2.2 Enough Time", "WCAG", "LOW"),
    Rule(40, "WCAG-2.3", "2.3 Seizures and Physical Reactions", "2.3 Seizures and Physical Reactions", "WCAG", "CRITICAL"),
    Rule(41, "WCAG-2.4", "2.4 Navigable", "2.4 Navigable", "WCAG", "HIGH"),
    Rule(42, "WCAG-2.5", "2.5 Input Modalities", "2.5 Input Modalities", "WCAG", "LOW"),
    Rule(43, "WCAG-3.1", "3.1 Readable", "3.1 Readable", "WCAG", "HIGH"),
    Rule(44, "WCAG-3.2", "3.2 Predictable", "3.2 Predictable", "WCAG", "MEDIUM"),
    Rule(45, "WCAG-3.3", "3.3 Input Assistance", "3.3 Input Assistance", "WCAG", "HIGH"),
    Rule(46, "WCAG-4.1", "4.1 Compatible", "4.1 Compatible", "WCAG", "HIGH"),
    Rule(47, "QUAL-HEAD-001", "Heading Hierarchy Integrity", "Heading Structure", "Quality", "MEDIUM", machine_testable=False),
    Rule(48, "QUAL-STRUCT-001", "Structural Quality & Ergonomics", "Structure Quality", "Quality", "LOW", machine_testable=False),
    Rule(49, "QUAL-TABLE-001", "Completeness of Table Elements", "Table Quality", "Quality", "HIGH"),
    Rule(50, "QUAL-LINK-001", "Meaningful Link Labels", "Link Quality", "Quality", "LOW", machine_testable=False),
    Rule(51, "QUAL-BOUND-001", "Tagged Content Page Boundaries", "Content Quality", "Quality", "HIGH"),
    Rule(52, "QUAL-TOC-001", "TOCI Elements Contain Link Elements", "Heading & Navigation Quality", "Quality", "HIGH"),
    Rule(53, "QUAL-TOC-002", "TOCI Elements Linked to Headings", "Heading & Navigation Quality", "Quality", "MEDIUM"),
    Rule(54, "QUAL-TEXT-001", "Alternative Text on Text Elements", "Alternative Text Quality", "Quality", "MEDIUM"),
    Rule(55, "QUAL-ALT-001", "Validity of Alternate Text", "Alternative Text Quality", "Quality", "HIGH"),
    Rule(56, "QUAL-NOTE-001", "Note Elements are Referenced", "Structure & Note Quality", "Quality", "HIGH"),
    Rule(57, "QUAL-NOTE-002", "Note Elements Contain Lbl Elements", "Structure & Note Quality", "Quality", "MEDIUM"),
    Rule(58, "QUAL-NOTE-003", "P Elements Contain Note Elements", "Structure & Note Quality", "Quality", "LOW"),
    Rule(59, "QUAL-ART-001", "Artifacted Content on Page Body", "Content Quality", "Quality", "HIGH"),
    Rule(60, "QUAL-LINK-002", "Completeness of Link Elements", "Link Quality", "Quality", "HIGH"),
    Rule(61, "QUAL-WHITE-001", "Tagged text consists of only whitespace", "Content Quality", "Quality", "HIGH"),
    Rule(62, "QUAL-TITLE-001", "Validity of Document Title", "Validity of document title", "Quality", "HIGH"),
    Rule(63, "QUAL-BOOKMARK-001", "Bookmarks If Headings Present", "Presence of bookmarks (document outline) if there are headings", "Quality", "MEDIUM"),
    Rule(64, "QUAL-LIST-001", "Formal Correctness of LI Elements", 'Formal correctness of "LI" elements', "Quality", "HIGH"),
    Rule(65, "AI-ALT-001", "Alt-Text Semantic Quality", "AI Alt-Text Evaluation", "AI", "MEDIUM"),
    Rule(66, "AI-READ-001", "Cognitive Readability Score", "Cognitive Accessibility", "AI", "INFO"),
    Rule(67, "AI-OUTLINE-001", "Structural Outline Consistency", "Structural AI", "AI", "INFO"),
]
RULES = {r.check_id: r for r in CATALOGUE}

#: Rules whose findings show the box of the node that their reference names.
BOXED = ("PDFUA-UNICODE-001", "PDFUA-TREE-001", "PDFUA-STRUCT-001", "PDFUA-STRUCT-002", "PDFUA-FIG-001", "PDFUA-ALT-001", "WCAG-1.1.1", "QUAL-ALT-001", "QUAL-WHITE-001", "QUAL-TEXT-001", "QUAL-LINK-002")

#: What to do about a rule's problems.
REMEDIES = {
    "PDFUA-SYNTAX-001": "Save the file anew with a tool that writes valid PDF, and let security settings admit assistive technology.",
    "PDFUA-FONT-001": "Embed every font, at least the glyphs in use.",
    "PDFUA-FONT-002": "Give the font a mapping to Unicode, or use one that has a standard encoding.",
    "PDFUA-UNICODE-001": "Replace private-use characters, or give their element a replacement text.",
    "PDFUA-UNICODE-002": "Mend the encoding that gives replacement characters.",
    "PDFUA-CONTENT-001": "Tag the document: export it with structure from the program it was written in.",
    "PDFUA-CONTENT-002": "Tag the content, or mark it as an artifact.",
    "PDFUA-CONTENT-004": "Take tagged content out of artifacts.",
    "PDFUA-CONTENT-005": "Name all marked content in the structure tree.",
    "PDFUA-CONTENT-006": "Take references to marked content that is not there out of the structure tree.",
    "PDFUA-CONTENT-007": "Do not nest marked content that has identifiers.",
    "PDFUA-ARTIFACT-001": "Take decoration out of the structure tree.",
    "PDFUA-ART-003": "Move artifacts out of tagged content.",
    "PDFUA-ANNOT-001": "Put the annotation into the structure tree.",
    "PDFUA-ANNOT-002": "Set the tab order of pages with annotations to that of the structure.",
    "PDFUA-FORM-001": "Give the field a name and a tooltip that say what it is for.",
    "PDFUA-EMBEDDED-001": "Describe embedded files, and check that they are accessible too.",
    "PDFUA-LANG-001": "Set the document's language.",
    "PDFUA-LANG-002": "Mark the language with a valid code.",
    "PDFUA-TREE-001": "Move the element to where its kind may stand.",
    "PDFUA-TREE-002": "Write the parent tree anew from the structure tree.",
    "PDFUA-STRUCT-001": "Use a standard type, and nest it as the standard allows.",
    "PDFUA-FIG-001": "Give the figure a bounding box of four numbers.",
    "PDFUA-LIST-001": "Build lists of items with labels and bodies.",
    "PDFUA-TABLE-001": "Mark header cells, and make rows equally wide.",
    "PDFUA-STRUCT-002": "Take empty elements out, or give them their content.",
    "PDFUA-ROLE-001": "Map every type of your own to a standard one, without circles.",
    "PDFUA-ALT-001": "Write an alternative text that says what is to be seen.",
    "PDFUA-META-001": "Add a stream of metadata.",
    "PDFUA-META-002": "Put the title into the metadata.",
    "PDFUA-META-003": "Add the identifier of the standard to the metadata.",
    "PDFUA-SETTINGS-001": "Let the window show the title in place of the file name.",
    "PDFUA-SETTINGS-003": "Add bookmarks.",
    "WCAG-1.1.1": "Give graphics and fields alternative texts.",
    "WCAG-1.2": "Provide captions or a transcript.",
    "WCAG-1.3": "Express structure in tags, not by looks.",
    "WCAG-1.4": "Check contrast and use of colour by eye.",
    "WCAG-2.1": "Make everything reachable by keyboard.",
    "WCAG-2.2": "Let readers take their time.",
    "WCAG-2.3": "Take out what flashes.",
    "WCAG-2.4": "Add a title, bookmarks and an order to follow.",
    "WCAG-2.5": "Allow other ways of input.",
    "WCAG-3.1": "Set the language of the document and of its parts.",
    "WCAG-3.2": "Let pages behave alike.",
    "WCAG-3.3": "Label fields, and say what went wrong.",
    "WCAG-4.1": "Give elements roles that assistive technology knows.",
    "QUAL-HEAD-001": "Begin with a first-level heading and skip no level.",
    "QUAL-STRUCT-001": "Take empty containers out, or fill them.",
    "QUAL-TABLE-001": "Complete the rows of the table.",
    "QUAL-LINK-001": "Label links by where they lead.",
    "QUAL-BOUND-001": "Move the content onto the page.",
    "QUAL-TOC-001": "Link contents entries.",
    "QUAL-TOC-002": "Let contents entries lead to their headings.",
    "QUAL-TEXT-001": "Take alternative texts off text.",
    "QUAL-ALT-001": "Describe the graphic in words of its own.",
    "QUAL-NOTE-001": "Refer to the note from the text.",
    "QUAL-NOTE-002": "Give the note a label.",
    "QUAL-NOTE-003": "Move the note out of the paragraph.",
    "QUAL-ART-001": "Tag text that is to be read.",
    "QUAL-LINK-002": "Put the link's content into its element.",
    "QUAL-WHITE-001": "Take elements of white space only out.",
    "QUAL-TITLE-001": "Set a title that says what the document is, and let it be shown.",
    "QUAL-BOOKMARK-001": "Make bookmarks of the headings.",
    "QUAL-LIST-001": "Build list items of a label and a body.",
    "AI-ALT-001": "Say in a sentence what matters in the graphic.",
    "AI-READ-001": "Shorten sentences and prefer common words.",
    "AI-OUTLINE-001": "Add bookmarks that follow the headings.",
}

#: Matrix categories in their order (fixed values), and where findings go.
CATEGORIES = {
    "PDF/UA": ["PDF Syntax (ISO 32000-1)", "Fonts", "Content", "Embedded Files", "Natural language", "Structure elements", "Structure tree", "Role mapping", "Alternative Descriptions", "Metadata", "Document settings"],
    "WCAG": [r.category for r in RULES.values() if r.standard == "WCAG"],
    "Quality": [
        "Validity of document title", "Artifacted content on page body", "Tagged text consists of only whitespace", "Tagged content exists outside of the page boundaries", "Presence of headings",
        "Presence of bookmarks (document outline) if there are headings", '"TOCI" elements contain "Link" elements', '"TOCI" elements correctly linked to headings', "Alternative text on text elements", "Validity of alternate text",
        'Completeness of "Link" elements', 'Formal correctness of "LI" elements', 'Completeness of "Table" elements', '"Note" elements are referenced', '"Note" elements contain "Lbl" elements', '"P" elements contain "Note" elements',
    ],
    "AI": ["Classification of the elements", "Unrecognized structural elements", "Missing structural elements"],
}
PDFUA_MOVES = {"Tables": "Structure elements", "Forms": "Structure elements", "Artifacts": "Content", "Syntax": "PDF Syntax (ISO 32000-1)", "PDF Syntax": "PDF Syntax (ISO 32000-1)"}
QUALITY_OF = {
    "QUAL-TITLE-001": 'Validity of document title',
    "QUAL-ART-001": 'Artifacted content on page body',
    "QUAL-WHITE-001": 'Tagged text consists of only whitespace',
    "QUAL-BOUND-001": 'Tagged content exists outside of the page boundaries',
    "QUAL-HEAD-001": 'Presence of headings',
    "QUAL-BOOKMARK-001": 'Presence of bookmarks (document outline) if there are headings',
    "QUAL-TOC-001": '"TOCI" elements contain "Link" elements',
    "QUAL-TOC-002": '"TOCI" elements correctly linked to headings',
    "QUAL-TEXT-001": 'Alternative text on text elements',
    "QUAL-ALT-001": 'Validity of alternate text',
    "QUAL-LINK-002": 'Completeness of "Link" elements',
    "QUAL-LIST-001": 'Formal correctness of "LI" elements',
    "QUAL-TABLE-001": 'Completeness of "Table" elements',
    "QUAL-NOTE-001": '"Note" elements are referenced',
    "QUAL-NOTE-002": '"Note" elements contain "Lbl" elements',
    "QUAL-NOTE-003": '"P" elements contain "Note" elements',
}
AI_MOVES = {"AI Alt-Text Evaluation": CATEGORIES["AI"][0], "Cognitive Accessibility": CATEGORIES["AI"][1], "Structural AI": CATEGORIES["AI"][2]}

#: Categories and names under which an external oracle lists the engine's rules (fixed values).
ORACLE_NAMES = {
    "PDFUA-CONTENT-001": ("Document", "Tagged PDF"),
    "PDFUA-TREE-001": ("Structure", "Structure Tree"),
    "PDFUA-META-002": ("Document", "Document Title"),
    "PDFUA-SETTINGS-001": ("Document", "Display Document Title"),
    "PDFUA-LANG-001": ("Document", "Document Language"),
    "PDFUA-SETTINGS-003": ("Document", "Bookmarks"),
    "PDFUA-ANNOT-002": ("Annotations", "Tab Order"),
    "PDFUA-FONT-001": ("Fonts", "Font Embedding"),
    "QUAL-LINK-001": ("Links", "Link"),
    "PDFUA-ALT-001": ("Images", "Alternate Text"),
    "PDFUA-FIG-001": ("Images", "Figure Tags"),
    "QUAL-HEAD-001": ("Structure", "Heading Structure"),
    "PDFUA-TABLE-001": ("Tables", "Table Headers (TH)"),
    "QUAL-TABLE-001": ("Tables", "Table Structure"),
    "PDFUA-FORM-001": ("Forms", "Form Field"),
}
