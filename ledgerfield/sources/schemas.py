"""Declared schemas of the raw sheets. Dates arrive as text and are parsed leniently later."""

from __future__ import annotations

RAW_SCHEMAS = {
    "Customers": "id string, Gender string, Date_of_birth string, region string, Location string, "
                 "Latitude double, Longitude double, created_at string",
    "Departments": "Id string, name string",
    "Users": "Id string, Name string, departmentId string, created_at string",
    "Products": "Id string, Product string, is_refurb boolean, created_at string",
    "Leads": "Id string, customer_id string, Source string, created_at string",
    "Installations": "Id string, Installation_date string, engineer_id string, created_at string, "
                     "updated_at string",
    "Accounts": "id string, customer_id string, status string, type string, created_at string, "
                "updated_at string, Installation_id string, Dispatch_date string, "
                "First_installment_date string, Agent_id string, Proudct_id string, "
                "lead_id string",
    "Sales": "Id string, account_id string, Sale_date string, created_at string, "
             "updated_at string",
}
