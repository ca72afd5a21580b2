"""Input views over the given tables, one text for Spark and for the SQL check.

The tables hold no mail and no journal links, so those operators get inputs that
are derived from whole tables. `<NAME>` marks what differs between dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DIALECT = {
    "spark": {
        "<TS>": "timestamp_micros",
        "<B64>": "replace(base64(encode(text, 'UTF-8')), concat(chr(13), chr(10)), '')",
    },
    "duck": {
        "<TS>": "make_timestamp",
        "<B64>": "to_base64(encode(text))",
    },
}

VIEWS = {
    # Items: the title of a document is its first line.
    "v_items": """
        SELECT doc_id AS item_id,
          CASE WHEN doc_id % 3 = 0 THEN 'sent' ELSE 'inbox' END AS folder,
          CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS folder_rank,
          doc_id AS ord,
          CASE WHEN doc_id % 29 = 0 THEN '  '
               ELSE concat(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END, split_part(text, chr(10), 1)) END AS title,
          CASE WHEN doc_id % 17 = 0 THEN ''
               ELSE concat('Customer#', lpad(cast(doc_id % 40 AS varchar(9)), 9, '0'), '@Lab.example.org') END AS sender,
          CASE WHEN doc_id % 7 = 0 THEN NULL
               WHEN doc_id % 7 = 1 THEN concat('http://img.example.org/', doc_id, '.png')
               ELSE concat(doc_id, '.webp') END AS img,
          CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('10.1/', doc_id) END AS doi,
          CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN '' ELSE concat('Journal ', doc_id % 11) END AS journal,
          text,
          <TS>(1663565400000000 + ((doc_id * 37) % 1400) * 86400000000 + ((doc_id * 13) % 24) * 3600000000) AS ts
        FROM documents""",
    "v_topics": """
        SELECT doc_id AS item_id,
          CASE WHEN doc_id % 23 = 0 THEN -1 ELSE (doc_id * 7) % 6 END AS topic,
          CASE WHEN doc_id % 23 = 0 THEN NULL ELSE concat('label ', (doc_id * 7) % 6) END AS topic_label,
          CASE WHEN doc_id % 31 = 0 THEN NULL ELSE <TS>(1663565400000000 + ((doc_id * 37) % 1400) * 86400000000) END AS ts
        FROM documents""",
    "v_urls": """
        SELECT page_id, CASE page_id % 26
          WHEN 0 THEN concat('https://doi.org/10.1016/j.cell.2024.', page_id, '.')
          WHEN 1 THEN concat('https://www.biorxiv.org/content/10.1101/2024.11.14.', page_id, 'v1?rss=1')
          WHEN 2 THEN concat('https://www.nature.com/articles/s41586-024-', page_id)
          WHEN 3 THEN concat('https://www.nature.com/articles/s41592-026-', page_id)
          WHEN 4 THEN concat('https://www.science.org/doi/full/10.1126/sciadv.', page_id, '#sec1')
          WHEN 5 THEN concat('https://www.pnas.org/doi/10.1073/pnas.', page_id)
          WHEN 6 THEN concat('https://journals.plos.org/plosone/article?id=10.1371/journal.pone.', page_id)
          WHEN 7 THEN concat('https://onlinelibrary.wiley.com/doi/10.1111/acel.', page_id)
          WHEN 8 THEN concat('https://link.springer.com/article/10.1007/s00', page_id)
          WHEN 9 THEN concat('https://genomebiology.biomedcentral.com/articles/10.1186/s13059-', page_id)
          WHEN 10 THEN concat('https://www.cell.com/cell-reports-medicine/fulltext/S2666-3791(24)0', page_id)
          WHEN 11 THEN concat('https://www.cell.com/trends/genetics/fulltext/S0168-9525(24)0', page_id)
          WHEN 12 THEN concat('https://www.sciencedirect.com/science/article/pii/S00928674', page_id)
          WHEN 13 THEN concat('https://www.thelancet.com/journals/lancet/article/PIIS0140-', page_id, '/fulltext')
          WHEN 14 THEN concat('https://elifesciences.org/articles/', 90000 + page_id)
          WHEN 15 THEN concat('https://academic.oup.com/bib/article/25/1/12/', page_id)
          WHEN 16 THEN concat('https://academic.oup.com/nar/article/doi/10.1093/nar/gk', page_id)
          WHEN 17 THEN concat('https://arxiv.org/abs/2401.', page_id)
          WHEN 18 THEN concat('https://github.com/org/repo', page_id)
          WHEN 19 THEN concat('https://doi.org/10.48550/arXiv.2401.', page_id)
          WHEN 20 THEN concat('https://genomemedicine.example.com/x/10.1186/s13073-', page_id)
          WHEN 21 THEN concat('https://www-nature-com.ez.srv.meduniwien.ac.at/articles/S41467-', page_id)
          WHEN 22 THEN 'mailto:nobody'
          WHEN 23 THEN ''
          WHEN 24 THEN concat('https://neurology.org/doi/10.1212/WNL.', page_id)
          ELSE url END AS url,
          CASE WHEN page_id % 9 = 0 THEN 'Prior Journal' ELSE '' END AS journal,
          CASE page_id % 4
            WHEN 0 THEN concat('https://www.cell.com/iscience/', page_id)
            WHEN 1 THEN concat('https://www.biorxiv.org/', page_id)
            WHEN 2 THEN concat('https://www.nature.com/nbt/', page_id)
            ELSE concat('https://press.example.org/', page_id) END AS resolved_url
        FROM pages""",
    "v_bodies": """
        SELECT doc_id AS item_id, CASE doc_id % 8
          WHEN 0 THEN concat('<div>', text, '</div><a originalsrc="https://www.nature.com/articles/s', doc_id,
            '?a=1&amp;b=2" href="https://eur03.safelinks.protection.outlook.com/?url=https%3A%2F%2Fwww.nature.com%2Fa%2F', doc_id, '&amp;data=1">x</a>')
          WHEN 1 THEN concat('<a originalsrc="https://home.example.org/">h</a><p>see https://example.org/paper/', doc_id, ' now</p>', text)
          WHEN 2 THEN concat('<style>p{color:red}</style><a class="l" href="https://a.io/', doc_id, '">t</a><p>', text, '</p>')
          WHEN 3 THEN concat('see https://eur03.safelinks.protection.outlook.com/?url=https%3A%2F%2Fx.org%2Fp%2F', doc_id, '&data=05')
          WHEN 4 THEN concat('Dear all,', chr(10), text, chr(10), 'https://journal.example.com/articles/', doc_id, chr(10), 'Best regards', chr(10), 'Sent from my phone')
          WHEN 5 THEN concat('^^ ', text)
          WHEN 6 THEN concat('header ^^ ^ tail ^^ ', text)
          ELSE '' END AS body,
          CASE doc_id % 5
            WHEN 0 THEN 'Here is a nice one'
            WHEN 1 THEN concat('Title number ', doc_id)
            WHEN 2 THEN '^ the follow up'
            WHEN 3 THEN 'paper on clocks'
            ELSE concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), ' =') END AS subject,
          text
        FROM documents""",
    # Messages: plain, quoted-printable and base64 parts carry the whole document.
    "v_messages": """
        SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS folder_rank, doc_id AS ord, concat(
          'a@b.org Mon Jan  1 00:00:00 2024', chr(10),
          CASE doc_id % 6
            WHEN 0 THEN concat('Subject: [paper] Short title ', doc_id % 50)
            WHEN 1 THEN concat('subject: [paper] Folded title', chr(10), '  continues ', doc_id)
            WHEN 2 THEN concat('Subject: RE: [paper] reply ', doc_id)
            WHEN 3 THEN CASE WHEN doc_id % 4 = 3 THEN 'Subject: [paper]   '
                        ELSE concat('Subject: [paper] Folded title', chr(10), '  goes on ', doc_id) END
            WHEN 4 THEN concat('Subject: [Paper] wrong case ', doc_id)
            ELSE concat('Subject: [paper] Title of item ', doc_id) END, chr(10),
          CASE WHEN doc_id % 2 = 0 THEN concat('From: "Member ', doc_id % 9, '" <member', doc_id % 9, '@Lab.example.org>')
               ELSE 'From: plain@lab.example.org' END, chr(10),
          CASE doc_id % 4
            WHEN 0 THEN 'Date: Mon, 05 Feb 2024 10:11:12 +0100'
            WHEN 1 THEN 'Date: 5 Feb 2024 10:11:12 +0000 '
            WHEN 2 THEN 'Date: Mon, 05 Feb 2024 10:11:12 +0100 (CET)'
            ELSE 'Date: yesterday' END, chr(10),
          CASE WHEN doc_id % 10 < 5 THEN 'Content-Type: text/plain'
               ELSE 'Content-Type: multipart/alternative; boundary="=_b.1"' END,
          CASE WHEN doc_id % 10 = 1 THEN concat(chr(10), 'Content-Transfer-Encoding: quoted-printable') ELSE '' END,
          chr(10), chr(10),
          CASE WHEN doc_id % 10 = 1 THEN concat('caf=C3=A9 ', replace(replace(text, '=', '=3D'), 'é', '=C3=A9'), ' soft=', chr(10), 'break')
               WHEN doc_id % 10 < 5 THEN concat('plain body ', doc_id, ' ', text, chr(10), 'From here on cut')
               WHEN doc_id % 10 < 8 THEN concat('--=_b.1', chr(10), 'Content-Type: text/html', chr(10), 'Content-Transfer-Encoding: base64',
                 chr(10), chr(10), <B64>, chr(10), '--=_b.1--')
               ELSE concat('--=_b.1', chr(10), 'Content-Type: image/png', chr(10), chr(10), 'xx', chr(10),
                 '--=_b.1', chr(10), 'Content-Type: text/plain', chr(10), chr(10), text, chr(10), '--=_b.1--') END) AS raw
        FROM documents""",
    "v_trend_orders": """
        SELECT o_orderkey AS item_id, cast(substring(o_orderpriority, 1, 1) AS int) AS topic, o_orderdate AS ts
        FROM orders""",
    "v_paths": """
        SELECT page_id, CASE page_id % 6
          WHEN 0 THEN 'index.html'
          WHEN 1 THEN concat('p/post-', page_id, '/index.html')
          WHEN 2 THEN concat('lab-manual/page-', page_id, '/index.html')
          WHEN 3 THEN concat('news/year-', 2000 + page_id, '.html')
          WHEN 4 THEN 'shared/insights.html'
          ELSE concat('section', page_id, '/index.html') END AS path
        FROM pages""",
}


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    def view(self, name: str) -> DataFrame:
        text = dialect(VIEWS[name], "spark")
        source = text.rsplit("FROM ", 1)[1].strip()
        alias = f"loreline_{source}"
        self.table(source).createOrReplaceTempView(alias)
        return self.spark.sql(text.rsplit("FROM ", 1)[0] + f"FROM {alias}")


def dialect(text: str, name: str) -> str:
    for mark, value in DIALECT[name].items():
        text = text.replace(mark, value)
    return text


def cte(*names: str) -> str:
    """The views as a WITH clause for the SQL check."""
    body = ",\n".join(f"{n} AS ({dialect(VIEWS[n], 'duck')})" for n in names)
    return f"WITH {body}"
