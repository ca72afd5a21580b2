"""Word lists, patterns and lookup tables that decide results.

Order is part of the meaning wherever a list is matched first-hit-wins.
"""

# ---- fixed values: lines of a message that are no content ------------------

BOILERPLATE_STARTS = (
    "dear", "best", "thanks", "regards", "sent from",
    "get outlook for", "microsoft", "original message",
    "from:", "to:", "cc:", "subject:", "date:",
    "forwarded message", "automatic reply", "out of office",
)
BOILERPLATE_LINES = ("br", "nbsp", "&nbsp;", "=20", "=3d", "reply")

# ---- fixed values: subjects that are comments, lines that are greetings -----

COMMENT_MARKS = ("^", "–", "-", "•")
COMMENT_PREFIXES = (
    "here is", "here's", "here:", "sorry", "interesting", "re:",
    "also", "check", "also check", "just", "plus", "btw",
)
GREETING_STARTS = ("dear", "best", "thanks", "regards", "sent", "get")

# ---- fixed values: DOI patterns on URLs, first hit ends the search -----------
# (pattern, capture group or None for "known host without DOI", prefix, tidy step)

DOI_PATTERNS = (
    (r"doi\.org/(10\.\d+/\S+)", 1, "", "clean"),
    (r"(biorxiv|medrxiv)\.org/content/(10\.\d+/\S+)", 2, "", "clean"),
    (r"(?i)nature\.com/articles/([a-z0-9-]+)", 1, "10.1038/", "keep"),
    (r"science\.org/doi/(?:full/)?(10\.\d+/\S+)", 1, "", "clean"),
    (r"pnas\.org/doi/(10\.\d+/\S+)", 1, "", "clean"),
    (r"journals\.plos\.org/[^/]+/article\?id=(10\.\d+/\S+)", 1, "", "clean"),
    (r"(?:onlinelibrary|advanced\.onlinelibrary)\.wiley\.com/doi/(10\.\d+/\S+)", 1, "", "clean"),
    (r"link\.springer\.com/(?:article|chapter)/(10\.\d+/\S+)", 1, "", "clean"),
    (r"biomedcentral\.com/articles/(10\.\d+/\S+)", 1, "", "clean"),
    (r"cell\.com/[^/]+/(?:fulltext|abstract|pdf)/\S*?(\d{4}-\d+X?[^?#\s]*)", None, "", "keep"),
    (r"cell\.com/[^/]+/pdf/(\S+)\.pdf", None, "", "keep"),
    (r"sciencedirect\.com/science/article/(?:pii|abs/pii)/(\S+)", 1, "10.1016/j.", "keep"),
    (r"(?i)www-nature-com\.ez\.srv\.meduniwien\.ac\.at/articles/([a-z0-9-]+)", 1, "10.1038/", "keep"),
    (r"thelancet\.com/journals/[^/]+/article/(\S+)", 1, "10.1016/", "cut"),
    (r"elifesciences\.org/articles/(\d+)", 1, "10.7554/eLife.", "keep"),
    (r"academic\.oup\.com/[^/]+/article(?:-abstract)?/doi/(10\.\d+/\S+)", 1, "", "clean"),
    (r"academic\.oup\.com/[^/]+/article(?:-abstract)?/\d+/\d+/\d+/(\d+)", None, "", "keep"),
    (r"pubs\.rsna\.org/doi/(10\.\d+/\S+)", 1, "", "clean"),
    (r"meridian\.allenpress\.com/[^/]+/doi/(10\.\d+/\S+)", 1, "", "clean"),
    (r"journals\.biologists\.com/[^/]+/doi/(10\.\d+/\S+)", 1, "", "clean"),
    (r"neurology\.org/doi/(10\.\d+/\S+)", 1, "", "clean"),
)
GENOME_HOSTS = r"(?i)genome(?:medicine|biology)\."
DOI_IN_PATH = r"/(10\.\d+/\S+)"
DOI_TRAILING = r"[.,;:/?#]+$"

# ---- fixed values: hosts ------------------------------------------------------
# The site of the group that runs the jobs is no journal either; pass it as `own_hosts`.

NON_JOURNAL_HOSTS = (
    "github.com", "github.io",
    "linkedin.com",
    "schemas.microsoft.com",
    "storage.googleapis.com",
    "semanticscholar.org",
    "bioptimus.com",
    "bmc-compbio.github.io",
)

SIMPLE_HOSTS = (
    ("arxiv.org", "arXiv"),
    ("biorxiv.org", "bioRxiv"),
    ("medrxiv.org", "medRxiv"),
    ("substack.com", "Substack"),
    ("openreview.net", "OpenReview"),
    ("pathologyjournal.rcpa.edu.au", "Pathology"),
    ("pubmed.ncbi.nlm.nih.gov", "PubMed"),
    ("ncbi.nlm.nih.gov", "PubMed"),
    ("openaccess.thecvf.com", "CVF Open Access"),
    ("academic.oup.com", "Oxford University Press"),
    ("pnas.org", "PNAS"),
    ("thelancet.com", "The Lancet"),
    ("wiley.com", "Wiley"),
    ("springer.com", "Springer"),
    ("plos.org", "PLOS"),
    ("elifesciences.org", "eLife"),
)

# ---- fixed values: path segments to journal names ------------------------------

CELL_PATHS = (
    ("/cell/", "Cell"),
    ("/immunity/", "Immunity"),
    ("/neuron/", "Neuron"),
    ("/developmental-cell/", "Developmental Cell"),
    ("/devcell/", "Developmental Cell"),
    ("/cell-reports-medicine/", "Cell Reports Medicine"),
    ("/cell-reports-methods/", "Cell Reports Methods"),
    ("/cell-reports/", "Cell Reports"),
    ("/cell-stem-cell/", "Cell Stem Cell"),
    ("/cell-metabolism/", "Cell Metabolism"),
    ("/cancer-cell/", "Cancer Cell"),
    ("/iscience/", "iScience"),
    ("/molecular-plant/", "Molecular Plant"),
)

DIRECT_PATHS = (
    *CELL_PATHS,
    ("s00928674", "Cell"),
    ("s10747613", "Immunity"),
)

SCIENCE_PATHS = (
    ("/science/", "Science"),
    ("/sciadv/", "Science Advances"),
    ("/scienceadvances/", "Science Advances"),
    ("/sciimmunol/", "Science Immunology"),
    ("/scitranslmed/", "Science Translational Medicine"),
    ("/scirobotics/", "Science Robotics"),
    ("/scienceinsignal/", "Science Signaling"),
)

NATURE_PATHS = (
    ("/s41586", "Nature"),
    ("/nature", "Nature"),
    ("/s41591", "Nature Methods"),
    ("/nmeth", "Nature Methods"),
    ("/s41587", "Nature Biotechnology"),
    ("/nbt", "Nature Biotechnology"),
    ("/ng", "Nature Genetics"),
    ("/s41588", "Nature Genetics"),
    ("/s41593", "Nature Neuroscience"),
    ("/nrn", "Nature Neuroscience"),
    ("/s41576", "Nature Reviews Genetics"),
    ("/nrg", "Nature Reviews Genetics"),
    ("/s41590", "Nature Immunology"),
    ("/ni", "Nature Immunology"),
    ("/s41577", "Nature Reviews Immunology"),
    ("/nri", "Nature Reviews Immunology"),
    ("/s41467", "Nature Communications"),
    ("/ncomms", "Nature Communications"),
    ("/s41556", "Nature Cell Biology"),
    ("/s41580", "Nature Reviews Molecular Cell Biology"),
    ("/s41579", "Nature Reviews Microbiology"),
    ("/s41584", "Nature Reviews Disease Primers"),
    ("/s41574", "Nature Reviews Endocrinology"),
    ("/s41581", "Nature Reviews Nephrology"),
    ("/s41568", "Nature Reviews Cancer"),
    ("/s41571", "Nature Reviews Clinical Oncology"),
    ("/s41572", "Nature Reviews Drug Discovery"),
    ("/s41573", "Nature Reviews Drug Discovery"),
    ("/s41575", "Nature Reviews Gastroenterology & Hepatology"),
    ("/s41578", "Nature Reviews Urology"),
    ("/s41582", "Nature Reviews Neurology"),
    ("/s41583", "Nature Reviews Neuroscience"),
    ("/s41594", "Nature Reviews Methods Primers"),
    ("/s41596", "Nature Protocols"),
    ("/nprot", "Nature Protocols"),
    ("/s41597", "Scientific Data"),
    ("/s41598", "Scientific Reports"),
    ("/s41698", "npj Precision Oncology"),
    ("/s41419", "Cell Death & Disease"),
    ("/s42003", "Communications Biology"),
    ("/s44160", "Nature Synthesis"),
    ("/s43587", "npj Aging"),
    ("/npjaging", "npj Aging"),
    ("/s41514", "npj Aging"),
    ("/s43588", "Nature Computational Science"),
    ("/s41540", "npj Systems Biology and Applications"),
    ("/s41601", "npj Biofilms and Microbiomes"),
    ("/s41684", "Lab Animal"),
    ("/s41551", "Nature Biomedical Engineering"),
    ("/s41563", "Nature Materials"),
    ("/s41564", "Nature Microbiology"),
    ("/s41566", "Nature Photonics"),
    ("/s41612", "npj Digital Medicine"),
    ("/s41746", "npj Digital Medicine"),
    ("/s41392", "Signal Transduction and Targeted Therapy"),
    ("/s41565", "Nature Nanotechnology"),
)

# (host substring, path table, name when no path segment matches)
HOST_FAMILIES = (
    ("cell.com", CELL_PATHS, "Cell Press"),
    ("sciencedirect.com", DIRECT_PATHS, "Cell Press"),
    ("science.org", SCIENCE_PATHS, "Science"),
    ("nature.com", NATURE_PATHS, "Nature Group"),
    ("nature-com", NATURE_PATHS, "Nature Group"),
)

DOI_PREFIXES = (("10.48550/arXiv.", "arXiv"),)

# ---- fixed values: thresholds of the topic series -------------------------------

NOISE_TOPIC = -1
SMOOTHING_MONTHS = 3
SMOOTHING_WEEKS = 12
MIN_POINTS = 4
MIN_MEAN = 0.1
RECENT_DAYS = 90
SIGNIFICANT_P = 0.1
MIN_SIGNIFICANT = 3
HOT_ABOVE = 0.1
COLD_BELOW = -0.1
