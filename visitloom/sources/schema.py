"""Declared schemas of the inputs that have one."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DateType()

# Column names and types of the back-office order table.
ORDER_DETAILS = T.StructType(
    [
        T.StructField("ATGSalesOrderNumber", _S),
        T.StructField("AXSalesOrderNumber", _S),
        T.StructField("OrderDate", _D),
        T.StructField("Customer_Status", _S),
        T.StructField("ORDERTYPE", _S),
        T.StructField("DWBRAND", _S),
        T.StructField("Business_Partner", _S),
        T.StructField("DWORDERTYPE", _S),
        T.StructField("DWResponseCode", _S),
        T.StructField("MarketingActivity", _S),
        T.StructField("ReportingSalesActivity", _S),
        T.StructField("Bottle_Quantity", T.LongType()),
        T.StructField("Revenue", T.DoubleType()),
        T.StructField("COUPON_CODE", _S),
        T.StructField("SALESSTATUS", _S),
        T.StructField("SalesOrderDate", T.TimestampType()),
        T.StructField("media", _S),
        T.StructField("BillingState", _S),
        T.StructField("Shippingaddress", _S),
    ]
)


def all_strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])
