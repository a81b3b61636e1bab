"""A small schema to try the catalog on: a shop, with views, copies, a restricted table and some rows."""

from pyspark.sql import DataFrame, SparkSession

from lodeseek.model import column, foreign_key, obj

_TABLES = {
    "core_party": "id int, legal_name string, country string",
    "core_address": "id int, id_party int, street string, city string",
    "crm_customer": "id int, id_party int, account_number string, segment string, credit_limit double, status string",
    "cat_product": "id int, sku string, title string, list_price double",
    "sales_order": "id int, order_number string, id_customer int, ordered_at string, currency string, total_net double",
    "sales_order_line": "id int, id_order int, id_product int, quantity double, unit_price double",
    "billing_invoice": "id int, invoice_number string, id_customer int, id_order int, issued_on string, total_gross double, status string",
    "billing_payment": "id int, id_invoice int, paid_on string, amount double, method string",
    "inv_warehouse": "id int, code string, city string",
    "inv_stock_level": "id int, id_warehouse int, id_product int, qty_on_hand double, reorder_point double",
    "ship_shipment": "id int, id_order int, id_warehouse int, dispatched_at string, delivered_at string",
    "hr_employee": "id int, id_party int, employee_number string, hired_on string, id_manager int",
    "hr_compensation": "id int, id_employee int, annual_amount double, pay_grade string",
    "crm_contact": "id int, id_customer int, full_name string, email string, phone string",
    "crm_campaign": "id int, title string, started_on string, budget double",
    "crm_ticket": "id int, id_customer int, opened_at string, closed_at string, subject string, severity string",
    "cat_category": "id int, title string, id_parent int",
    "cat_price_list": "id int, id_product int, valid_from string, price double, currency string",
    "cat_supplier_item": "id int, id_product int, id_pur_supplier int, supplier_sku string, lead_days int",
    "sales_quote": "id int, quote_number string, id_customer int, valid_until string, total_net double",
    "sales_return": "id int, id_order int, returned_on string, reason string, refund double",
    "sales_channel": "id int, code string, title string",
    "billing_invoice_line": "id int, id_invoice int, id_product int, quantity double, net double",
    "billing_credit_note": "id int, id_invoice int, issued_on string, amount double",
    "billing_tax_rate": "id int, country string, rate double, valid_from string",
    "inv_stock_move": "id int, id_warehouse int, id_product int, moved_at string, quantity double, kind string",
    "inv_count": "id int, id_warehouse int, counted_on string, id_employee int",
    "pur_supplier": "id int, id_party int, supplier_number string, rating int",
    "pur_order": "id int, po_number string, id_supplier int, ordered_on string, total_net double",
    "pur_order_line": "id int, id_pur_order int, id_product int, quantity double, unit_cost double",
    "pur_receipt": "id int, id_pur_order int, id_warehouse int, received_on string",
    "ship_carrier": "id int, code string, title string",
    "ship_tracking_event": "id int, id_shipment int, happened_at string, place string, state string",
    "hr_department": "id int, title string, id_manager int",
    "hr_leave": "id int, id_employee int, first_day string, last_day string, kind string",
    "fin_account": "id int, number string, title string, kind string",
    "fin_ledger_entry": "id int, id_account int, booked_on string, debit double, credit double",
    "dim_ct_mstr": "id int, ct_cd string, ct_desc string, actv_flg int",
    "sales_order_bkp": "id int, order_number string, id_customer int",
    "fct_txn_ln": "id int, txn_dt string, id_ct int, amt double, qty double",
}
_VIEWS = {
    "v_customer_balance": "SELECT c.id AS customer, sum(i.total_gross) AS billed FROM crm_customer c JOIN billing_invoice i ON i.id_customer = c.id GROUP BY c.id",
    "v_stock_shortfall": "SELECT p.sku, s.reorder_point - s.qty_on_hand AS shortfall FROM inv_stock_level s JOIN cat_product p ON p.id = s.id_product WHERE s.qty_on_hand < s.reorder_point",
}
HINTS = {
    "billing_invoice": "Invoices as issued to customers; unpaid ones have status open",
    "billing_payment": "Payments received against invoices",
    "fct_txn_ln": "Sales transactions by line, from the old system",
    "inv_stock_level": "Stock on hand by warehouse and product",
    "crm_ticket": "Complaints and questions of customers to the help desk",
    "sales_return": "Goods sent back by customers and what was refunded",
    "hr_leave": "Holidays and sick days of staff",
    "cat_supplier_item": "Which supplier sells a product and how long delivery takes",
    "billing_tax_rate": "Value added tax by country",
    "ship_tracking_event": "Where a parcel was seen on its way",
    "dim_ct_mstr": "Categories of the old system's transactions",
    "fin_ledger_entry": "Bookings of the general ledger",
}
GOLDEN = {
    "Which invoices are still unpaid?": {"billing_invoice"},
    "stock on hand by warehouse": {"inv_stock_level", "inv_warehouse"},
    "orders of each customer": {"sales_order", "crm_customer"},
    "shipment delivered late": {"ship_shipment"},
    "open tickets by severity": {"crm_ticket"},
    "total of purchase orders by supplier": {"pur_order", "pur_supplier"},
    "employees in each department": {"hr_employee", "hr_department"},
    "returns and their reason": {"sales_return"},
    "credit notes of an invoice": {"billing_credit_note", "billing_invoice"},
    "price of a product over time": {"cat_price_list"},
    "ledger entries of an account": {"fin_ledger_entry", "fin_account"},
    "stock moves last week": {"inv_stock_move"},
}
#: The same needs in the words of the business.
PARAPHRASES = {
    "who still owes us money": {"billing_invoice"},
    "which goods did people send back": {"sales_return"},
    "complaints to the help desk": {"crm_ticket"},
    "who is on holiday": {"hr_leave"},
    "where is the parcel now": {"ship_tracking_event"},
    "how long does delivery from a supplier take": {"cat_supplier_item"},
    "value added tax of each country": {"billing_tax_rate"},
    "bookings of the general ledger": {"fin_ledger_entry"},
    "transactions of the old system": {"fct_txn_ln"},
    "goods available in stores": {"inv_stock_level"},
}
RESTRICTED = {"hr_compensation": ["payroll"]}
SEED = {
    "core_party": [(1, "Acme", "DE"), (2, "Globex", "FR"), (3, "Initech", "US")],
    "crm_customer": [(1, 1, "A-1", "retail", 1000.0, "active"), (2, 2, "A-2", "trade", 500.0, "active"), (3, 3, "A-3", "retail", 0.0, "closed")],
    "sales_order": [(1, "O-1", 1, "2026-01-02", "EUR", 90.0), (2, "O-2", 1, "2026-01-05", "EUR", 10.0), (3, "O-3", 2, "2026-02-01", "EUR", 70.0)],
    "billing_invoice": [(1, "I-1", 1, 1, "2026-01-03", 107.1, "paid"), (2, "I-2", 1, 2, "2026-01-06", 11.9, "open"), (3, "I-3", 2, 3, "2026-02-02", 83.3, "open")],
}


def demo_objects() -> list[dict]:
    """Objects of the demo; the key columns of crm_customer and sales_order_line are declared, the others are to be inferred."""
    out = []
    for name, ddl in _TABLES.items():
        cols = [column(*c.split(), pk=c.startswith("id ")) for c in ddl.split(", ")]
        declared = [foreign_key(["id_party"], "core_party", ["id"])] if name == "crm_customer" else [foreign_key(["id_order"], "sales_order", ["id"])] if name == "sales_order_line" else []
        out.append(obj(name, hint=HINTS.get(name), columns=cols, foreign_keys=declared, roles=RESTRICTED.get(name)))
    for name, sql in _VIEWS.items():
        shown = {"v_customer_balance": ("customer", "billed"), "v_stock_shortfall": ("sku", "shortfall")}[name]
        out.append(obj(name, kind="VIEW", definition=sql, columns=[column(c, "double") for c in shown]))
    return out


def demo_recall(catalog, questions: dict[str, set], top_k: int = 6) -> tuple[float, float]:
    """The share of gold objects that selections of these questions have, and the mean share of tokens that they save."""
    picked = [(catalog.select(q, top_k=top_k), gold) for q, gold in questions.items()]
    found = sum(len(gold & set(s.table_names())) for s, gold in picked)
    return found / sum(map(len, questions.values())), sum(s.savings() for s, _ in picked) / len(picked)


def demo_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame(SEED.get(n, []), ddl) for n, ddl in _TABLES.items()}
