"""All registered queries by name."""

from postlens.plans import activity, cleaning, evaluation, ingest, opinion, topics

QUERIES = {
    **opinion.QUERIES,
    **cleaning.QUERIES,
    **evaluation.QUERIES,
    **ingest.QUERIES,
    **topics.QUERIES,
    **activity.QUERIES,
}
