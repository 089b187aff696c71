"""All registered queries of the library and the SQL each is held against."""

from formline.plans import boards, form, loads, points, seasons  # noqa: F401  (modules register their queries)
from formline.plans.tables import ORACLE_SQL, QUERIES  # noqa: F401
