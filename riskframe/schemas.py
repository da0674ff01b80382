"""Explicit schemas for every table the operators read or write."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


# Header of the order-item file (after trimming) and the type
# each column is read with.
ORDER_FILE = _struct(
    ("Type", S),
    ("Days for shipping (real)", I),
    ("Days for shipment (scheduled)", I),
    ("Benefit per order", D),
    ("Sales per customer", D),
    ("Delivery Status", S),
    ("Late_delivery_risk", I),
    ("Category Id", L),
    ("Category Name", S),
    ("Customer City", S),
    ("Customer Country", S),
    ("Customer Email", S),
    ("Customer Fname", S),
    ("Customer Id", L),
    ("Customer Lname", S),
    ("Customer Password", S),
    ("Customer Segment", S),
    ("Customer State", S),
    ("Customer Street", S),
    ("Customer Zipcode", S),
    ("Department Id", L),
    ("Department Name", S),
    ("Latitude", D),
    ("Longitude", D),
    ("Market", S),
    ("Order City", S),
    ("Order Country", S),
    ("Order Customer Id", L),
    ("order date (DateOrders)", S),
    ("Order Id", L),
    ("Order Item Cardprod Id", L),
    ("Order Item Discount", D),
    ("Order Item Discount Rate", D),
    ("Order Item Id", L),
    ("Order Item Product Price", D),
    ("Order Item Profit Ratio", D),
    ("Order Item Quantity", D),
    ("Sales", D),
    ("Order Item Total", D),
    ("Order Profit Per Order", D),
    ("Order Region", S),
    ("Order State", S),
    ("Order Status", S),
    ("Order Zipcode", S),
    ("Product Card Id", L),
    ("Product Category Id", L),
    ("Product Description", S),
    ("Product Image", S),
    ("Product Name", S),
    ("Product Price", D),
    ("Product Status", S),
    ("shipping date (DateOrders)", S),
    ("Shipping Mode", S),
)

# File header -> column name used by the operators.
ORDER_COLUMNS = {
    "Order Id": "order_id",
    "Order Item Id": "order_item_id",
    "Product Name": "product",
    "Category Name": "category",
    "Department Name": "department",
    "Market": "market",
    "Order Region": "region",
    "Order Country": "order_country",
    "Order City": "order_city",
    "Customer Segment": "customer_segment",
    "Shipping Mode": "shipping_mode",
    "Delivery Status": "delivery_status",
    "Order Status": "order_status",
    "Days for shipping (real)": "days_real",
    "Days for shipment (scheduled)": "days_scheduled",
    "Late_delivery_risk": "late_delivery_risk",
    "order date (DateOrders)": "order_date",
    "shipping date (DateOrders)": "ship_date",
    "Order Item Quantity": "quantity",
    "Sales": "sales",
    "Order Item Discount": "discount",
    "Order Profit Per Order": "profit",
    "Order Item Profit Ratio": "profit_ratio",
}

# SKU file header -> (column name, type).
SKU_COLUMNS = {
    "Product type": ("product_type", S),
    "SKU": ("sku", S),
    "Price": ("price", D),
    "Availability": ("availability", I),
    "Number of products sold": ("units_sold", I),
    "Revenue generated": ("revenue", D),
    "Customer demographics": ("customer_demographics", S),
    "Stock levels": ("stock_levels", I),
    "Lead times": ("lead_time", I),
    "Order quantities": ("order_quantities", I),
    "Shipping times": ("shipping_time", I),
    "Shipping carriers": ("carrier", S),
    "Shipping costs": ("shipping_cost", D),
    "Supplier name": ("supplier", S),
    "Location": ("location", S),
    "Lead time": ("supplier_lead_time", I),
    "Production volumes": ("production_volumes", I),
    "Manufacturing lead time": ("manufacturing_lead_time", I),
    "Manufacturing costs": ("manufacturing_costs", D),
    "Inspection results": ("inspection", S),
    "Defect rates": ("defect_rate", D),
    "Transportation modes": ("transport_mode", S),
    "Routes": ("route", S),
    "Costs": ("costs", D),
}

METADATA = T.MapType(S, S)
INCIDENT = _struct(("id", S), ("text", S), ("metadata", METADATA))

ANOMALY = _struct(
    ("anomaly_type", S),
    ("severity", S),
    ("description", S),
    ("affected_segment", S),
    ("metric_value", D),
    ("threshold", D),
    ("confidence", D),
    ("recommendation", S),
    ("supporting_data", T.MapType(S, D)),
    ("n", L),
)

MANIFEST = _struct(("key", S), ("rows", L), ("docs", L), ("loaded_at", D))
RUN_LOG = _struct(
    ("run_key", S),
    ("state", S),
    ("rows_loaded", L),
    ("docs_built", L),
    ("docs_indexed", L),
    ("elapsed_sec", D),
    ("error", S),
)
FEEDBACK = _struct(("session_id", S), ("message_id", S), ("rating", S), ("note", S), ("ts", D))
EVENT = _struct(
    ("event_id", L),
    ("ts", T.TimestampNTZType()),
    ("user_id", L),
    ("event_type", S),
    ("value", D),
    ("props", S),
)
