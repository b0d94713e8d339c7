"""kvern.functions"""
