"""Word lists, label aliases, weights and patterns that decide results. They are data, stated as they must be."""

# fixed values: vocabularies
SEARCH_STOP = "a an and are by find for get give has have in is it me of on please show the this what which who with".split()
HEADINGS = ["from", "to", "supplier", "buyer", "bill to", "description", "subtotal", "grand total", "bank details", "notes", "terms", "item", "component"]
ROW_SECTIONS = ["description", "hsn", "item", "component", "material", "qty", "quantity", "rate", "taxable"]
SKIP_LABELS = ["description", "qty", "quantity", "rate", "amount", "tax", "item", "component", "unit", "hsn", "sac", "sr no", "line no"]
TABLE_HEADER = "amount code component description ext extended gst header hsn item material measure note notes part pos position qty quantity rate remarks revision taxable unit uom".split()
ITEM_STOPS = ["notes", "note", "approved by", "authorised signatory", "authorized signatory", "terms", "bank details", "summary", "total", "grand total"]
ROW_CONTEXT_STOP = "amount code description gst hsn hr hrs item line material month nos part pcs price qty quantity rate sac tax taxable total unit uom".split()
ROUTER_ROW = ["item", "line", "line item", "rate", "qty", "quantity", "price", "part", "material", "hsn", "code"]
ROUTER_TOTAL = ["amount", "amount payable", "final amount", "grand total", "invoice total", "net amount", "subtotal", "total"]
FILTER_ROW = ["item", "line", "rate", "qty", "quantity", "price", "part", "material", "vehicle", "revenue", "profit", "cash", "balance"]
FILTER_TOTAL = ["amount", "total", "grand total", "invoice total", "amount payable", "net amount"]
ANSWER_ROW = ["item", "line", "rate", "qty", "quantity", "price", "part", "material", "code"]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# fixed values: labels of the canonical fields, in order of preference, and their types
ALIASES = {
    "doc_number": ("text", ["invoice no", "invoice number", "document no", "document number", "bill no", "bill number", "voucher no", "voucher number", "bom no", "bom number", "ref no", "reference no"]),
    "supplier_name": ("text", ["supplier", "supplier name", "vendor", "vendor name", "seller", "seller name", "from", "issued by", "manufacturer"]),
    "buyer_name": ("text", ["buyer", "buyer name", "customer name", "bill to", "ship to", "consignee", "to"]),
    "doc_date": ("date", ["date", "invoice date", "document date", "bill date", "issue date", "created date", "posting date", "effective date"]),
    "amount": ("amount", ["grand total", "total amount", "invoice total", "net amount", "amount payable", "final amount", "total invoice value", "total"]),
    "currency": ("text", ["currency"]),
    "gstin": ("gstin", ["gstin", "supplier gstin", "gst number"]),
    "buyer_gstin": ("gstin", ["buyer gstin", "customer gstin", "consignee gstin", "bill to gstin"]),
    "po_number": ("text", ["po no", "po number", "purchase order no", "purchase order number", "customer po"]),
    "payment_terms": ("text", ["payment terms", "terms of payment", "payment condition"]),
    "part_number": ("text", ["part no", "part number", "assembly no", "assembly number", "material code", "item code"]),
    "revision": ("text", ["revision", "rev", "revision no", "revision number"]),
    "plant_code": ("text", ["plant", "plant code", "site", "site code", "location code"]),
}
ACTIVE = {
    "invoice": ["doc_number", "supplier_name", "buyer_name", "doc_date", "amount", "currency", "gstin", "buyer_gstin", "po_number", "payment_terms"],
    "bom": ["doc_number", "supplier_name", "buyer_name", "doc_date", "part_number", "revision", "plant_code", "currency"],
    "receipt": ["doc_number", "supplier_name", "buyer_name", "doc_date", "amount", "currency"],
    "unknown": ["doc_number", "supplier_name", "buyer_name", "doc_date", "amount", "currency"],
}
ITEM_COLUMNS = {
    "item_no": ["item", "item no", "item number", "sr no", "line no", "position", "pos"],
    "part_number": ["part no", "part number", "component code", "material code", "item code", "code"],
    "description": ["description", "component", "component name", "part description", "material description"],
    "quantity": ["qty", "quantity", "req qty", "required qty", "usage qty"],
    "unit": ["unit", "uom", "measure", "unit of measure"],
    "revision": ["rev", "revision"],
    "remarks": ["remarks", "remark", "note", "notes"],
}

# fixed values: patterns, tried in order
DOC_NUMBER = [r"\b([A-Z]{1,8}-[A-Z]{1,8}-\d{4}-\d+)\b", r"\b(INV-[A-Z0-9-]+)\b", r"\b(GST-INV-[A-Z0-9-]+)\b", r"\b(BOM-[A-Z0-9-]+)\b", r"\b([0-9]{4}-[A-Z]{2}-[0-9]{2})\b"]
DOC_DATE = [r"\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})\b", r"\b([0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{4})\b", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", r"\b([0-9]{1,2}\s+[A-Za-z]{3,9}\s*,?\s*[0-9]{4})\b"]
TOTAL = r"(?:Grand Total|Total Amount|Invoice Total|Net Amount|Amount Payable|Final Amount|Total)\s*[:\-]?\s*(?:Rs\.?|INR|₹|I)?\s*([0-9][0-9I,]*\.\d{2}|[0-9][0-9I,]*)"
QUERY_NUMBER = [r"\b([A-Z]{1,10}/[0-9]{4}(?:-[0-9]{2})?/[0-9]{3,})\b", r"\b([A-Z]{1,8}-[A-Z]{1,8}-\d{4}-\d+)\b", r"\b(GST-INV-[A-Z0-9-]+)\b", r"\b(INV-[A-Z0-9-]+)\b", r"\b(BOM-[A-Z0-9-]+)\b", r"\b([0-9]{4}-[A-Z]{2}-[0-9]{2})\b"]
QUERY_SUPPLIER = r"(?:from|supplier|vendor)\s+([A-Za-z0-9&., -]+?)(?:\s+in\s+[A-Za-z]+\s+[0-9]{4}|\s+for\s+|\?|$)"
QUERY_AMOUNT = [r"(?:amount|total|invoice total|grand total|amount payable|net amount)\s*(?:is|=|:)?\s*(?:rs\.?|inr|₹)?\s*([0-9,]+(?:\.\d{1,2})?)", r"\b([0-9,]+\.\d{2})\b"]
NUMERIC_ONLY = r"^\s*(?:rs\.?|inr|₹)?\s*[0-9,]+(?:\.\d{1,2})?\s*$"
MATERIAL = r"[A-Z]{1,5}-\d{2,}[A-Z0-9-]*"
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d.M.yyyy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "d MMM, yyyy", "d MMMM, yyyy"]

# fixed values: source weights by route (keyword, scored SQL text, vector), boosts and thresholds
ROUTE_WEIGHTS = {"lexical": (0.3, 0.7, 0.0), "mixed": (0.2, 0.6, 0.2), "hybrid": (0.2, 0.35, 0.45)}
FIELD_BOOSTS = {"search_text": 4.0, "chunk_text": 3.0, "section": 1.5, "doc_number": 2.0, "supplier_name": 2.0}
REASONS = {"exact": "exact identifier match", "structured": "structured metadata filter", "vector": "semantic similarity", "keyword": "keyword match", "postgres_keyword": "database text match"}
