"""Mail about the driver's orders: each line of an order is one message of its thread, written from templates that the line's keys choose.

The statement is in the words that Spark SQL and DuckDB share, so that both sides of a comparison read the same mail.
What a message is about (truth) is known from its line. Bodies hold what misleads readers: conditions, abbreviations, quoted
older messages, signatures, footers, HTML references, links, and adverts between the real ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import table


def pick(number: str, *options: str) -> str:
    """SQL for one of some texts, by a number."""
    joined = "|".join(options).replace("'", "''")
    return f"split_part('{joined}', '|', CAST(({number}) % {len(options)} AS INT) + 1)"


SAYS = {
    "Applied": (
        "Thank you for applying for the ROLE role. We have received your application.",
        "Your application for ROLE at EMPLOYER was received and is under review.",
        "We confirm that your application has reached EMPLOYER Sdn. Bhd. today. If you are selected for an interview, we will contact you.",
        "Dear candidate, thanks for your interest in ROLE. The team will look at it.",
    ),
    "Assessment / OA": (
        "As the next step, please complete the online assessment within five days.",
        "You did well, and we ask you to take a coding test before Friday.",
        "You are invited to a one-way video interview for ROLE. Record your answers by Friday.",
        "The challenge closes on Friday. Please finish it in time.",
    ),
    "Interview": (
        "We would like to invite you to an interview on Monday.",
        "Could you meet our hiring manager next week to talk about the ROLE role?",
        "Thank you for applying. Your interview is scheduled for 10 a.m. on Tuesday at EMPLOYER.",
    ),
    "Offer": (
        "We are pleased to offer you the position of ROLE.",
        "Congratulations! Attached is your letter of offer from EMPLOYER.",
        "Thank you for the interview. We are delighted to extend an offer of employment.",
    ),
    "Rejected": (
        "Unfortunately we will not be moving forward with your application.",
        "Thank you for applying. After careful review we have decided to pursue other candidates.",
        "We regret to inform you that the position has been filled.",
    ),
    "Ghosted": (
        "Top jobs this week: 15 new roles match your profile. Apply now!",
        "Top jobs for you, since your application shows what you can do.",
        "Career tips for you: join our webinar. Your application deserves it.",
        "Please verify your account to go on reading EMPLOYER news.",
    ),
    "Withdrawn": (
        "Your receipt for order 77 is attached.",
        "Are you around for lunch tomorrow?",
        "Our team is hiring and looks for a candidate like you.",
    ),
}
SUBJECTS = {
    "Applied": ("Thank you for applying to EMPLOYER for ROLE", "ROLE at EMPLOYER", "Application received"),
    "Assessment / OA": ("Next step: online assessment", "EMPLOYER: your test", "ROLE at EMPLOYER"),
    "Interview": ("Interview with EMPLOYER", "EMPLOYER: Next steps", "Your interview"),
    "Offer": ("Offer for ROLE", "EMPLOYER: good news", "Your offer"),
    "Rejected": ("Your application to EMPLOYER", "ROLE at EMPLOYER", "Update"),
    "Ghosted": ("Weekly job alert", "Grow with us", "Verify your account"),
    "Withdrawn": ("Receipt 77", "Lunch", "Vacancies at EMPLOYER"),
}
TAILS = (
    "",
    "\n--\nThe EMPLOYER team",
    "\nOn Mon, 1 Jan 2001, Ann Lee wrote:\n> Unfortunately we will not be moving forward.",
    "\nPlease do not reply. Privacy policy applies. Unsubscribe.",
    "\n> We are pleased to offer you nothing.\nBest regards &amp; good luck, EMPLOYER&#39;s team",
)
LINKS = (
    "",
    "\nApply or view the job here: https://ats.example/jobs/KEY?utm_source=mail&id=KEY",
    "\nFollow us: https://social.example/share/KEY https://careers.EMPLOYERHOST.example/position/KEY.",
    "\nLogo https://img.example/KEY.png\nThe posting: https://www.EMPLOYERHOST.example/about/KEY",
)
FIRST_NAMES = ("Tasik", "Rimba", "Jati", "Sinar", "Bayu", "Mega", "Damai", "Permata", "Warisan", "Kencana", "Utama")
SECOND_NAMES = ("Analytics", "Retail", "Energy", "Logistics", "Insurance", "Software", "Bank", "Staffing", "Consulting", "Advisory")
LEVELS = ("Senior", "Junior", "Graduate", "Lead", "Contract", "Intern", "Part-time", "", "Trainee", "Head of")
JOBS = ("Data Analyst", "Claims Clerk", "Risk Engineer", "Marketing Planner", "Actuarial Associate", "Accounts Officer", "Business Analyst", "Developer")
STATUS = """CASE l_returnflag || l_linestatus WHEN 'RO' THEN CASE WHEN l_discount >= 0.08 THEN 'Offer' ELSE 'Interview' END WHEN 'RF' THEN 'Rejected'
  WHEN 'AF' THEN 'Assessment / OA' WHEN 'AO' THEN 'Ghosted' WHEN 'NF' THEN 'Withdrawn' ELSE 'Applied' END"""


def by_status(texts: dict[str, tuple[str, ...]], number: str) -> str:
    return f"CASE truth {' '.join(f"WHEN '{s}' THEN {pick(number, *t)}" for s, t in texts.items())} END"


def written(x: str) -> str:
    """A template with its names put in."""
    return f"replace(replace(replace(replace({x}, 'EMPLOYERHOST', host), 'EMPLOYER', employer), 'ROLE', role), 'KEY', CAST(k AS STRING))"


def statement(day: Callable[[str, str], str], lineitem: str = "lineitem", orders: str = "orders") -> str:
    """SQL for the mail; day(date, number) writes a day so many days later."""
    senders = ("no-reply@ats.example", "EMPLOYER <hr@HOST.example>", "jobs@board.example", "Jane Tan <jane@HOST.example>", "tests@assess.example", "careers@HOST.example", "info@news.example")
    sender = pick("l_suppkey", *senders)
    return f"""lines AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey, {STATUS} AS truth, CAST(o_orderdate AS DATE) AS opened,
         {pick('o_custkey', *FIRST_NAMES)} || ' ' || {pick('o_custkey / 1', *SECOND_NAMES)} AS employer,
         lower({pick('o_custkey', *FIRST_NAMES)} || {pick('o_custkey / 1', *SECOND_NAMES)}) AS host,
         trim({pick('o_orderkey', *LEVELS)} || ' ' || {pick('o_custkey', *JOBS)}) AS role
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey),
mail AS (
  SELECT k, CAST(l_orderkey AS STRING) AS thread_id, CAST(k AS STRING) AS message_id, truth, employer, role,
         {day('opened', 'CAST(l_linenumber * 9 + l_partkey % 5 AS INT)')} AS day,
         {day('opened', 'CAST(l_linenumber * 9 + l_partkey % 5 + CASE WHEN l_partkey % 6 = 0 THEN 25 ELSE 0 END AS INT)')} AS arrived,
         replace(replace({sender}, 'EMPLOYER', employer), 'HOST', host) AS sender,
         {written(by_status(SUBJECTS, 'l_partkey'))} AS subject,
         {written(f"({by_status(SAYS, 'l_partkey + l_suppkey')} || {pick('l_partkey', *LINKS)} || {pick('l_partkey / 1 + l_linenumber', *TAILS)})")} AS body,
         CASE WHEN k % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split,
         CASE WHEN l_partkey % 2 = 0 THEN 'even ' ELSE '' END || CASE WHEN (l_partkey + l_linenumber) % 5 = 2 THEN 'quoted ' ELSE '' END || CASE WHEN l_suppkey % 7 = 4 THEN 'vendor ' ELSE '' END AS tags
  FROM lines)""".replace(" / 1", "")


SPARK = statement(lambda date, n: f"date_add({date}, {n})", "{lineitem}", "{orders}")
DUCKDB = statement(lambda date, n: f"{date} + {n}")


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, thread_id, message_id, truth, employer, role, day, arrived, sender, subject, body, split, tags)."""
    return spark.sql(f"WITH {SPARK} SELECT * FROM mail", lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
