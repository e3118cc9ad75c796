"""The source application's seed rows, retyped with small integer ids.

Departments 1..5, users 1..3, suppliers 1..3, products 1..8, customers 1..3;
no bills.  Values as in the seed script of the source application.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from tillroll.sources import schema as S
from tillroll.sources.catalog import Retail

T0 = dt.datetime(2024, 1, 1)

# Seed rows (name, description / contact / product and customer fields).
DEPARTMENTS = [
    (1, "Groceries", "Daily essentials, food items, and beverages", 2, True, T0),
    (2, "Electronics", "Consumer electronics, appliances, and accessories", None, True, T0),
    (3, "Clothing", "Apparel, footwear, and fashion accessories", None, True, T0),
    (4, "Home & Kitchen", "Household items, kitchenware, and furniture", None, True, T0),
    (5, "Health & Beauty", "Personal care, medicines, and wellness products", None, True, T0),
]
USERS = [
    (1, "Store Admin", "admin@store.com", "admin", None, True),
    (2, "Store Manager", "manager@store.com", "manager", 1, True),
    (3, "John Cashier", "cashier@store.com", "cashier", 1, True),
]
SUPPLIERS = [
    (1, "Fresh Foods Distributor", "raj@freshfoods.com", True),
    (2, "Tech World Supplies", "priya@techworld.com", True),
    (3, "Fashion Hub", "meena@fashionhub.com", True),
]
PRODUCTS = [
    (1, "Basmati Rice 5kg", "GRC001", "8901234567890", D("350.00"), D("0"), 100, 20, "packet", "Rice & Grains", 1, 1, True),
    (2, "Toor Dal 1kg", "GRC002", "8901234567891", D("120.00"), D("0"), 80, 15, "packet", "Pulses", 1, 1, True),
    (3, "Sunflower Oil 1L", "GRC003", "8901234567892", D("130.00"), D("5"), 60, 10, "bottle", "Cooking Oil", 1, 1, True),
    (4, "Amul Milk 1L", "GRC004", "8901234567893", D("55.00"), D("0"), 50, 20, "litre", "Dairy", 1, 1, True),
    (5, "Wheat Flour 5kg", "GRC005", "8901234567894", D("220.00"), D("0"), 70, 15, "packet", "Flour", 1, 1, True),
    (6, "USB-C Cable 1m", "ELC001", "8901234567900", D("299.00"), D("18"), 40, 5, "piece", "Cables", 2, 2, True),
    (7, "Bluetooth Earphones", "ELC002", "8901234567901", D("1499.00"), D("18"), 25, 3, "piece", "Audio", 2, 2, True),
    (8, "Phone Charger 20W", "ELC003", "8901234567902", D("699.00"), D("18"), 30, 5, "piece", "Chargers", 2, 2, True),
]
CUSTOMERS = [
    (1, "Amit Sharma", "amit@example.com", "+91-9999000001", 2500, "silver", D("25000.00"), True),
    (2, "Priya Patel", "priya@example.com", "+91-9999000002", 850, "bronze", D("8500.00"), True),
    (3, "Ravi Verma", "ravi@example.com", "+91-9999000003", 12000, "gold", D("120000.00"), True),
]


def seed_catalog(spark) -> Retail:
    frames = {
        "departments": spark.createDataFrame(DEPARTMENTS, S.DEPARTMENTS),
        "users": spark.createDataFrame(USERS, S.USERS),
        "suppliers": spark.createDataFrame(SUPPLIERS, S.SUPPLIERS),
        "products": spark.createDataFrame(PRODUCTS, S.PRODUCTS),
        "customers": spark.createDataFrame(CUSTOMERS, S.CUSTOMERS),
    }
    return Retail.from_frames(spark, frames)
