"""Schemas of the stored tables."""

from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"STRING": StringType(), "TIMESTAMP": TimestampType(), "DATE": DateType(), "BIGINT": LongType(), "BOOLEAN": BooleanType(), "MONEY": DecimalType(38, 2)}


def _schema(columns: str) -> StructType:
    """Columns as ``name TYPE [NOT NULL]``; needs no session, unlike a DDL string."""
    fields = [c.split() for c in columns.split(", ")]
    return StructType([StructField(name, _TYPES[kind], nullable=not rest) for name, kind, *rest in fields])


BRONZE = _schema("run_id STRING NOT NULL, source_system STRING NOT NULL, entity_name STRING NOT NULL, source_record_id STRING, source_org_key STRING, source_org_id STRING, source_org_name STRING, source_country STRING, source_currency STRING, raw_json STRING NOT NULL, gcs_uri STRING, loaded_at TIMESTAMP NOT NULL")
RUNS = _schema("run_id STRING NOT NULL, source_system STRING NOT NULL, status STRING NOT NULL, started_at TIMESTAMP NOT NULL, completed_at TIMESTAMP, records_loaded BIGINT, error_message STRING, metadata_json STRING, triggered_by STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL")
UPLOADS = _schema("upload_id STRING, file_type STRING, original_file_name STRING, gcs_raw_path STRING, uploaded_by STRING, uploaded_at TIMESTAMP, parse_status STRING, records_parsed BIGINT, error_message STRING")
BANK_LINES = _schema("bank_line_id STRING, upload_id STRING, bank_name STRING, account_number_masked STRING, transaction_date DATE, value_date DATE, narration STRING, debit_amount MONEY, credit_amount MONEY, balance_amount MONEY, reference_number STRING, raw_row_number BIGINT, created_at TIMESTAMP")
GSTR_LINES = _schema("gstr_line_id STRING, upload_id STRING, gstr_type STRING, period STRING, supplier_gstin STRING, supplier_name STRING, invoice_number STRING, invoice_date DATE, taxable_value MONEY, igst_amount MONEY, cgst_amount MONEY, sgst_amount MONEY, total_tax MONEY, invoice_value MONEY, created_at TIMESTAMP")

#: Entities and the field that holds their record id.
ENTITY_IDS = {"accounts": "account_id", "contacts": "contact_id", "invoices": "invoice_id", "bills": "bill_id", "expenses": "expense_id", "customer_payments": "payment_id", "journals": "journal_id", "transactions": "transaction_id"}
