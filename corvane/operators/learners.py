"""Progress, grades, access, deadlines and the catalogue, for all learners at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import normalize_for_search, search_terms
from corvane.session import checkpointed

DONE = (1, 2)  # complete, complete with a pass
#: Rows up to which a side is broadcast.
FEW = 500_000
#: Users of a course whose pairs with its methods lie together.
BLOCK = 256


def learner_progress(states: DataFrame, host: DataFrame | None = None) -> DataFrame:
    """Tracked and complete activities of each user and course, with the host's own percentage where it has one."""
    by = states.groupBy("userid", "courseid").agg(F.count("*").alias("tracked"), F.count(F.when(F.col("state").isin(*DONE), 1)).alias("complete"))
    own = F.round(F.col("complete") / F.col("tracked") * 100, 2)
    if host is None:
        return by.withColumn("percent", own)
    return by.join(host.select("userid", "courseid", F.col("percent").alias("__p")), ["userid", "courseid"], "left").withColumn("percent", F.coalesce("__p", own)).drop("__p")


def learner_grade_summary(states: DataFrame, grades: DataFrame) -> DataFrame:
    """Final grade (two decimals) and number of pending activities."""
    pending = learner_progress(states).select("userid", "courseid", (F.col("tracked") - F.col("complete")).alias("pending"))
    return pending.join(grades.select("userid", "courseid", F.round("grade", 2).alias("grade")), ["userid", "courseid"], "left")


def gradebook_items(items: DataFrame, grades: DataFrame) -> DataFrame:
    """Visible items of each course with each user's grade, and the course total on every row."""
    shown = items.filter("NOT hidden")
    rows = shown.join(grades, "itemid", "left")
    total = F.max(F.when(F.col("itemtype") == "course", F.col("grade"))).over(W.partitionBy("courseid", "userid"))
    return rows.withColumn("coursetotal", total).filter("itemtype <> 'course'")


def forum_participation(posts: DataFrame, discussions: DataFrame) -> DataFrame:
    joined = posts.join(discussions.select("discussionid", "forumid", "firstpostid"), "discussionid")
    opened = F.count(F.when(F.col("postid") == F.col("firstpostid"), 1))
    return joined.groupBy("userid", "forumid").agg(F.count("*").alias("posts"), opened.alias("discussions"), F.max("created").alias("lastpost"))


def quiz_attempt_state(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Finished and running attempts (overdue ones run), and how many are allowed; no limit is null. Previews don't count."""
    real = attempts.filter("NOT preview")
    by = real.groupBy("userid", "quizid").agg(F.count(F.when(F.col("state") == "finished", 1)).alias("finished"), F.count(F.when(F.col("state").isin("inprogress", "overdue"), 1)).alias("inprogress"))
    return by.join(quizzes.select("quizid", F.nullif("allowed", F.lit(0)).alias("allowed")), "quizid")


def attempts_in_order(attempts: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("userid", "quizid").orderBy("attempt")
    return attempts.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def submission_status(submissions: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """The latest submission of each key, and whether it came after its due date."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in latest))
    last = submissions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    given = F.col("submitted").isNotNull()
    return last.withColumns({"issubmitted": given, "late": given & F.coalesce(F.col("submitted") > F.col("due"), F.lit(False))})


def access_status(enrolments: DataFrame, courses: DataFrame, now: str) -> DataFrame:
    """active, expired (with the last end), not_started (with the first start), suspended, course_hidden or course_ended."""
    day = F.lit(now).cast("date")
    usable = ~F.col("suspended")
    over = usable & F.coalesce(F.col("timeend") < day, F.lit(False))
    ahead = usable & ~over & F.coalesce(F.col("timestart") > day, F.lit(False))
    by = enrolments.groupBy("userid", "courseid").agg(F.max(F.when(over, F.col("timeend"))).alias("ended"), F.min(F.when(ahead, F.col("timestart"))).alias("starts"), F.bool_or(usable & ~over & ~ahead).alias("live"))
    df = by.join(courses.select("courseid", "visible", "enddate"), "courseid")
    gone = F.coalesce(F.col("enddate") < day, F.lit(False))
    live = F.col("live")
    status = (
        F.when(~live & F.col("ended").isNotNull(), "expired")
        .when(~live & F.col("starts").isNotNull(), "not_started")
        .when(~live, "suspended")
        .when(~F.col("visible"), "course_hidden")
        .when(gone, "course_ended")
        .otherwise("active")
    )
    df = df.withColumn("status", status)
    since = F.when(F.col("status") == "expired", F.col("ended")).when(F.col("status") == "not_started", F.col("starts")).when(F.col("status") == "course_ended", F.col("enddate"))
    return df.select("userid", "courseid", "status", since.alias("day"))


# What each enrolment method asks for.
RESTRICTIONS = {"guest": "guest", "fee": "payment", "paypal": "payment", "manual": "managed", "cohort": "managed", "meta": "managed", "database": "managed"}


def enrolment_restriction(methods: DataFrame, default_cost: float | None = None) -> DataFrame:
    """none, key, cohort, payment, guest, managed or other; paid methods have a cost, by default the site's."""
    m = F.col("method")
    self_ = F.when(F.coalesce("cohortid", F.lit(0)) > 0, "cohort").when(F.coalesce("password", F.lit("")) != "", "key").otherwise("none")
    kind = F.when(m == "self", self_)
    for name, what in RESTRICTIONS.items():
        kind = kind.when(m == name, what)
    df = methods.withColumn("restriction", kind.otherwise("other"))
    return df.withColumn("cost", F.when(F.col("restriction") == "payment", F.coalesce(F.col("cost"), F.lit(default_cost).cast("double"))))


def enrolment_availability(methods: DataFrame, users: DataFrame, enrolled: DataFrame, members: DataFrame, now: str) -> DataFrame:
    """For users and the methods of the course they look at (column courseid of both): available and reason."""
    day = F.lit(now).cast("date")
    seats = enrolled.groupBy("methodid").agg(F.count("*").alias("taken"))
    # what a user is in is one row beside the user, so that the pairs of users and methods are never shuffled
    held = lambda df, c, name: df.filter(F.col(c).isNotNull()).groupBy("userid").agg(F.collect_set(c).alias(name))
    people = users.select("userid", "courseid").join(held(enrolled, "methodid", "__in"), "userid", "left").join(held(members, "cohortid", "__of"), "userid", "left")
    # The pairs come out method by method for some BLOCK users of a course at a time: so runs of equal values and the same few users again and again are what
    # a columnar file gets, and it takes a fraction of a byte for a pair. Blocks are few bytes, but each becomes many rows: dealt to all cores, which adaptive
    # execution would not do.
    sizes = checkpointed(users.groupBy("courseid").agg(F.ceil(F.count("*") / BLOCK).alias("__blocks")))
    people = people.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, "courseid").withColumn("__block", F.pmod(F.xxhash64("userid"), F.col("__blocks")))
    people = people.repartition(4 * people.sparkSession.sparkContext.defaultParallelism, "courseid", "__block")
    blocks = people.groupBy("courseid", "__block").agg(F.collect_list(F.struct("userid", "__in", "__of")).alias("__users")).drop("__block")
    offers = checkpointed(enrolment_restriction(methods).join(seats, "methodid", "left"))
    df = blocks.join(F.broadcast(offers) if offers.count() <= FEW else offers, "courseid")
    df = df.select(*offers.columns, F.explode("__users").alias("__u")).select(*offers.columns, "__u.*")
    df = df.withColumn("__in", F.coalesce(F.array_contains("__in", F.col("methodid")), F.lit(False))).withColumn("__member", F.array_contains("__of", F.col("cohortid")))
    own = F.col("method") == "self"
    reason = (
        F.when(F.col("restriction").isin("managed", "other"), None)
        .when(F.col("__in"), "already_enrolled")
        .when(F.col("opens") > day, "not_open_yet")
        .when(F.col("closes") < day, "closed")
        .when(own & ~F.col("newenrols"), "new_enrolments_disabled")
        .when(own & (F.col("seats") > 0) & (F.coalesce("taken", F.lit(0)) >= F.col("seats")), "full")
        .when(own & (F.coalesce("cohortid", F.lit(0)) > 0) & ~F.coalesce("__member", F.lit(False)), "cohort_only")
        .when(F.col("restriction") == "key", "needs_key")
    )
    df = df.withColumn("reason", reason)
    may = F.when(F.col("restriction").isin("managed", "other"), None).otherwise(F.col("reason").isNull() | (F.col("reason") == "needs_key"))
    return df.select("userid", "courseid", "methodid", "restriction", may.alias("available"), "reason")


def unread_notifications(notes: DataFrame, n: int = 5) -> DataFrame:
    """Each user's number of unread notifications, and the subjects of the newest n."""
    unread = notes.filter("timeread IS NULL")
    w = W.partitionBy("userid").orderBy(F.desc("timecreated"), F.desc("noteid"))
    latest = unread.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).groupBy("userid").agg(F.array_sort(F.collect_list(F.struct("__n", "subject"))).alias("__x"))
    return unread.groupBy("userid").agg(F.count("*").alias("unread")).join(latest, "userid").select("userid", "unread", F.col("__x.subject").alias("latest"))


def member_groups(memberships: DataFrame) -> DataFrame:
    """Distinct groups of each user and course, by name."""
    return memberships.dropDuplicates(["userid", "courseid", "groupid"]).groupBy("userid", "courseid").agg(F.transform(F.array_sort(F.collect_list(F.struct("groupname", "groupid"))), lambda g: g["groupname"]).alias("groups"))


def catalogue(courses: DataFrame, mine: DataFrame, site_course: int, category: str | None, now: str) -> DataFrame:
    """Courses that may be listed: not the site's, visible, in the category tree if one is given, not over unless mine."""
    df = courses.filter((F.col("courseid") != site_course) & F.col("visible"))
    if category is not None:
        df = df.filter(in_category_tree("path", category))
    df = df.join(mine.select("courseid", F.lit(True).alias("mine")).distinct(), "courseid", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    return df.filter(F.col("mine") | F.col("enddate").isNull() | (F.col("enddate") >= F.lit(now).cast("date")))


def in_category_tree(path: str, category: str):
    return F.array_contains(F.split(path, "/"), category)


def catalogue_page(courses: DataFrame, text: str, offset: int, limit: int) -> DataFrame:
    """A page of courses whose names hold every term, and whether there are more."""
    hay = normalize_for_search(F.concat_ws(" ", "fullname", "shortname"))
    terms = search_terms(F.lit(text))
    hit = courses.filter(F.forall(terms, lambda t: hay.contains(t)))
    page = hit.orderBy("fullname", "courseid").offset(offset).limit(limit + 1)
    numbered = page.withColumn("place", F.row_number().over(W.orderBy("fullname", "courseid")))  # limit + 1 rows at most
    return numbered.withColumn("has_more", F.count("*").over(W.partitionBy(F.lit(1))) > limit).filter(F.col("place") <= limit)


def activity_search(activities: DataFrame, text: str, limit: int) -> DataFrame:
    """Activities by the number of matched terms, then shorter names."""
    terms, name = search_terms(F.lit(text)), normalize_for_search("name")
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    matched = F.size(F.filter(terms, lambda t: padded.contains(F.concat(F.lit(" "), t))))
    return activities.withColumn("matched", matched).filter("matched > 0").orderBy(F.desc("matched"), F.char_length("name"), "cmid").limit(limit)


def my_courses(rows: DataFrame, state: str, offset: int, limit: int) -> DataFrame:
    """A page of each user's courses by last access, then name; ``completed``, ``inprogress`` or all."""
    if state == "completed":
        rows = rows.filter("percent >= 100")
    elif state == "inprogress":
        rows = rows.filter("percent < 100")
    w = W.partitionBy("userid").orderBy(F.desc_nulls_last("lastaccess"), "fullname", "courseid")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place").between(offset + 1, offset + limit))


def deadlines(events: DataFrame, now: str, days: int, limit: int, shown: DataFrame | None = None) -> DataFrame:
    """Each user's deadlines from a week ago to ``days`` ahead, in time order, past ones flagged; those already shown are left out."""
    day = F.lit(now).cast("date")
    df = events.filter((F.col("due") >= F.date_sub(day, 7)) & (F.col("due") <= F.date_add(day, days)))
    if shown is not None:
        df = df.join(shown, ["userid", "eventid"], "left_anti")
    w = W.partitionBy("userid").orderBy("due", "eventid")
    return df.withColumns({"overdue": F.col("due") < day, "place": F.row_number().over(w)}).filter(F.col("place") <= limit)


CREDENTIAL = ["userid", "type", "name", "issuer", "courseid", "issued", "expires", "code", "url", "source"]


def credentials(*sources: DataFrame) -> DataFrame:
    """The union of credential sources under one schema; what a source lacks is null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    for c in CREDENTIAL:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*CREDENTIAL)


def certificate_credentials(issues: DataFrame, templates: DataFrame, modules: DataFrame, courses: DataFrame) -> DataFrame:
    """Certificate issues with template name, and course module and course where they still exist."""
    df = issues.join(templates.select("templateid", "name"), "templateid").join(modules.select("templateid", "cmid", "visible"), "templateid", "left").join(courses.select("courseid", "fullname"), "courseid", "left")
    return df.select("userid", F.lit("certificate").alias("type"), "name", F.col("fullname").alias("issuer"), "courseid", "issued", "code", F.when(F.col("visible"), F.concat(F.lit("/mod/"), F.col("cmid").cast("string"))).alias("url"), F.lit("certificate").alias("source"))


