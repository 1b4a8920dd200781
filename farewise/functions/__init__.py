"""Column functions: native Catalyst expressions, no Python UDFs."""

from farewise.functions.geo import (  # noqa: F401
    haversine_miles,
    register_sql_functions,
    vertex_center,
    wkt_vertices,
)
from farewise.functions.price import expected_price  # noqa: F401
from farewise.functions.timeofday import (  # noqa: F401
    minute_of_day,
    parse_time_of_day,
    signed_minute_diff,
)
